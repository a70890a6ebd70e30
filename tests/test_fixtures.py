"""Edge semantics on hand-made rows: text, ranking, course collections, logs, sources."""

import pytest
from pyspark.sql import functions as F

from siftwell.functions import text as tx
from siftwell.operators import chunking, hydrate, lexical, lms, logs, metrics, models, ranking
from siftwell.sources import crawl, feeds, html, tables


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("given", "wanted"), [("<b>hi</b> <> a < b", "hi <> a < b"), ("x < y and z > w", "x  w"), ("\xa0<p>t</p>\x1f", "t"), ("<<a>>", ">"), ("", ""), (None, None)])
def test_clean_text(spark, given, wanted):
    assert one(spark, given, tx.clean_text) == wanted


def test_escape_preview_layout(spark):
    assert one(spark, "a&b<c>\"d'", tx.html_escape) == "a&amp;b&lt;c&gt;&quot;d&#x27;"
    assert one(spark, "# T\n\nline3\x0bline4\r\nl5 l6\x1cl7\n", tx.preview) == "line3\nline4\nl5\nl6\nl7"
    assert one(spark, "only", tx.preview) == ""
    assert one(spark, "• a\n\n\n\nb   c ", tx.normalised_layout) == "* a\n\nb c"
    assert one(spark, "1.2: Title", tx.without_index) == "Title"
    assert one(spark, "/en/a/b/", tx.slug) == "en_a_b"
    assert [one(spark, x, tx.file_extension) for x in ("a.tar.gz", ".bashrc", "a")] == [".gz", "", ""]
    assert [one(spark, x, tx.is_no_info) for x in ("Sorry, no", "Извините…", "The room is 108")] == [True, True, False]


@pytest.mark.parametrize(("n", "count"), [(0, 0), (1, 1), (512, 1), (513, 2), (896, 2), (897, 3), (1280, 3), (1281, 4)])
def test_chunks_cover_all_tokens(spark, n, count):
    words = [f"w{i}" for i in range(n)]
    rows = chunking.chunk(spark.createDataFrame([(1, " ".join(words))], "id int, text string")).orderBy("chunk_number").collect()
    assert len(rows) == count
    assert [w for r in rows for w in r["content"].split()[128 if r["chunk_number"] else 0 :]] == words


@pytest.mark.parametrize(
    ("limit", "rows", "wanted"),
    [
        (2, [("s", "d1", 0.9), ("s", "d1", 0.8), ("s", "d2", 0.7)], ["d1"]),
        (3, [("s", "d1", 0.9), ("s", "d1", 0.8), ("s", "d2", 0.7)], ["d1", "d2"]),
        (3, [("s", "d1", 0.5), ("s", "d2", 0.025), ("s", "d3", 0.0249)], ["d1", "d2"]),
        (3, [("maps", "7", 0.5), ("hotel", "7", 0.5)], ["7", "7"]),
        (3, [], []),
    ],
)
def test_ranking_order(spark, limit, rows, wanted):
    df = spark.createDataFrame([(1, *r) for r in rows], "query_id int, resource string, mongo_id string, score double")
    got = ranking.finish(ranking.top_n(df, limit, ["query_id"], ties=["resource"])).orderBy("final_rank").collect()
    assert [r["mongo_id"] for r in got] == wanted


def test_knn_leaves_out_zero_and_null_vectors(spark):
    e = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, 1.0]), (4, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = ranking.knn(e, e.where("vec_id = 0"), 5).collect()
    assert [(r["id"], round(r["score"], 6)) for r in got] == [(4, 1.0), (3, 0.707107)]
    assert e.where("vec_id in (0, 3)").agg(F.max("embedding").alias("a"), F.min("embedding").alias("b")).select(F.round(ranking.cosine(F.col("a"), F.col("b")), 6)).first()[0] == 0.707107
    with pytest.raises(ValueError):
        ranking.knn(e, e, 0)


def test_knn_in_blocks_gives_the_same(spark, sf_dir, monkeypatch):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = e.where("vec_id % 20 = 0")
    once = ranking.knn(e, asked, 5, source_col="label").orderBy("query_id", "source", "rank").collect()
    monkeypatch.setattr(ranking, "MOST_BROADCAST", 7)
    monkeypatch.setattr(ranking, "BLOCK_ROWS", 100)
    assert ranking.knn(e, asked, 5, source_col="label").orderBy("query_id", "source", "rank").collect() == once


CONTENTS = "course_id long, module_id long, contents array<struct<type:string,filename:string,timecreated:long,timemodified:long,uploaded:boolean>>"


@pytest.mark.parametrize(("old", "new", "after"), [((1, 2, True), (1, 2, False), True), ((1, 2, True), (1, 3, False), False), ((None, None, True), (None, None, False), True), (None, (1, 2, False), False), ((1, 2, False), (1, 2, True), False)])
def test_carry_forward(spark, old, new, after):
    stored = spark.createDataFrame([(1, 1, [("file", "f", *old)])] if old else [], CONTENTS)
    incoming = spark.createDataFrame([(1, 1, [("file", "z", 0, 0, False), ("file", "f", *new)])], CONTENTS)
    once = lms.upsert_modules(stored, incoming)
    assert [(c["filename"], c["uploaded"]) for c in once.first()["contents"]] == [("z", False), ("f", after)]
    assert lms.upsert_modules(once, once).collect() == once.collect()


def test_positional_update_takes_the_first(spark):
    df = spark.createDataFrame([(1, 1, [("file", n, 0, 0, False) for n in "abb"])], CONTENTS)
    got = df.select(lms.mark_uploaded(F.col("contents"), F.lit("b"), F.lit(5), F.lit(6)).alias("c")).first()["c"]
    assert [c["uploaded"] for c in got] == [False, True, False]


def test_feedback_rejects(spark):
    log = spark.createDataFrame([(1, [("a", 0.5, None), ("b", 0.4, None)])], "id int, wrapped_responses array<struct<source:string,score:double,user_feedback:string>>")
    given = spark.createDataFrame([(1, 1, "like"), (1, -1, "like"), (1, 2, "like"), (9, 0, "like")], "id int, response_index int, feedback string")
    done, refused = logs.apply_feedback(log, given)
    assert [r["user_feedback"] for r in done.first()["wrapped_responses"]] == [None, "like"]
    assert sorted(r["reason"] for r in refused.collect()) == ["index out of range", "index out of range", "unknown id"]


def test_history_checks_the_owner(spark):
    sessions = spark.createDataFrame([(1, "me", [("user", "q0")])], "chat_id int, owner string, history array<struct<role:string,content:string>>")
    turns = spark.createDataFrame([(1, "you", "q", "a"), (2, "you", "q", "a")], "chat_id int, owner string, question string, answer string")
    whole, refused = logs.append_history(sessions, turns)
    assert {r["chat_id"]: len(r["history"]) for r in whole.collect()} == {1: 1, 2: 2}
    assert refused.first()["chat_id"] == 1


@pytest.mark.parametrize(("rel", "wanted"), [([0, 1, 1], (0.5, 0.666667, 0.246661, 0.693426)), ([], (0, 0, 0, 0))])
def test_metrics(spark, rel, wanted):
    got = metrics.evaluate(spark.createDataFrame([(rel,)], "rel array<int>")).first()
    assert tuple(round(got[m], 6) for m in ("rr", "ap_ref", "ndcg_ref", "ndcg_std")) == wanted


def test_lexical_limit_and_sections(spark):
    pages = spark.createDataFrame([("1", "u", "Dorm rules", "quiet hours"), ("2", "u", "Dorm map", "rooms"), ("3", "u", "Food", "x")], "id string, source_url string, source_page_title string, content string")
    asked = spark.createDataFrame([(1, "dorm dorm rules")], "query_id int, query string")
    assert [r["doc"] for r in lexical.lexical_hits({"hotel": pages}, asked, ["hotel", "clubs"], 0).orderBy("final_rank").collect()] == ["1", "2"]
    assert lexical.lexical_hits({"hotel": pages}, asked, ["hotel"], 1).count() == 1
    with pytest.raises(ValueError):
        lexical.lexical_hits({}, asked, ["nowhere"])

    def down():
        raise ConnectionError

    def late():  # a plan that fails when it is run
        return asked.select(F.raise_error(F.lit("down")).alias("doc"))

    found = asked.select(F.lit("vector").alias("doc"))
    for f, wanted in ((down, "lexical"), (late, "lexical"), (lambda: found, "vector")):
        assert lexical.with_fallback(f, lambda: asked.select(F.lit("lexical").alias("doc"))).first()["doc"] == wanted
    row = lexical.scored(spark.createDataFrame([("a", 0.5)], "doc string, score double")).first()
    assert (row["score"], row["inner"]["doc"]) == (0.5, "a")


def test_course_rows(spark):
    entries = spark.createDataFrame([(1, 2, 3, "[Sum24] X / Y", "m", [("file", "f", 0, 0, False), ("url", "g", 0, 0, False)])], "course_id long, section_id long, module_id long, course_fullname string, module_name string, contents array<struct<type:string,filename:string,timecreated:long,timemodified:long,uploaded:boolean>>")
    rows = hydrate.shape_course_rows(entries).orderBy("filename").collect()
    assert [r["type"] for r in rows] == ["moodle-file", "moodle-url"]
    assert rows[0]["display_name"] == "m / f" and rows[0]["breadcrumbs"] == ["Moodle", "[Sum24] X", "m"] and rows[0]["object_key"] == "moodle/1/3/f"


def test_links_and_crawl(spark):
    page = '<a href="mailto:x">m</a><a href="tel:1">t</a><a href="#x">f</a><a href="https://other.org/a">o</a><a href="/a.PDF">p</a><a href="/">h</a><a href="/en">e</a><a href="/en/a/b/">k</a><a href="/en/a/b/">k</a>'
    df = spark.createDataFrame([(1, "https://h.org/x", page)], "page_id long, url string, html string")
    assert [(r["target"], r["file"]) for r in crawl.internal_links(df).collect()] == [("https://h.org/en/a/b/", "en_a_b.md")]
    links = spark.createDataFrame([("s", "https://w.org/p#f"), ("s", "/rel"), ("s", "https://w.org/skip"), ("s", "https://w.org/p?oldid=1"), ("s", "#x")], "source string, href string")
    assert [r["target"] for r in crawl.wiki_edges(links, "w.org", ["/skip"]).collect()] == ["https://w.org/p"]


def test_feeds(spark):
    body = '[{"scene_id":"s","title":"Floor 1","areas":[{"title":"108","svg_polygon_id":"z","description":"a\\nb","people":["p","x","q","y"]}]}]'
    got = feeds.map_documents(spark.createDataFrame([(body,)], "body string")).first()
    assert got["content"] == "# Floor 1\n### 108\n**Description:** a  \nb  \n**People:** p, q" and got["title"] == "108 on Floor 1"
    clubs = spark.createDataFrame([('[{"id":"c","title":"T","short_description":"d","type":"art","links":[{"type":"telegram_chat","link":"http://t_x"},{"type":"other","link":"y"}]}]',)], "body string")
    leaders = spark.createDataFrame([("c", "N", "a_b")], "club_id string, name string, telegram_alias string")
    assert feeds.club_documents(clubs, leaders).first()["content"] == "# T\nd\n\n**Club leader:** N [@a\\_b](https://t.me/a\\_b)\n\n**Telegram chat:** [join](http://t\\_x)"


def test_crawl_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(105)] + [("p105", "p0")], "source string, target string").coalesce(1)
    got = crawl.reachable(edges, spark.createDataFrame([("p0",)], "page string")).collect()
    assert sorted((r["depth"], r["page"]) for r in got) == [(i, f"p{i}") for i in range(106)]


def test_html_sections_of_deep_pages(spark):
    deep = 3000
    plain, headed = "<body>" + "<i>x " * deep, "<body>" + "<div><i>" * deep + "<h2>A</h2>a<h2>B</h2>b" + "<b>" * deep + "c"
    df = spark.createDataFrame([(1, plain), (2, headed)], "page_id long, html string")
    got = {(r["page_id"], r["title"]): r["content"] for r in html.page_sections(df).collect()}
    assert set(got) == {(1, ""), (2, "A"), (2, "B")}
    assert got[1, ""] == " ".join("x" * deep) and got[2, "A"] == "a" and got[2, "B"] == "b" + "**" * deep + "c" + "**" * deep


def test_html_sections():
    page = "<body><h1>T</h1><div id=one><h2>A</h2><p>x<p>y</div><div id=two><h2>B</h2></div><div><h2>C</h2><ul><li>i<li>j</ul><script>no</script><table><tr><th>h1<th>h2<tr><td>a<td>b</table></div>"
    assert html.sections(page) == [("one", "A", "x\n\ny"), ("", "C", "- i\n- j\n\n- a\n\t- h2: b")]
    assert html.sections("<title>t</title><body>x") == [("", "t", "x")]
    assert html.sections("") == []


def test_html_sections_outer(spark):
    df = spark.createDataFrame([(None, None), (2**53 + 1, "<p></p>"), (3, "<title>a&amp</title><h2>A</h2>a<h2>B</h2>b"), (4, "<![x[y]]><p>b")], "page_id long, html string").coalesce(1)
    a = [(3, 0, "A", "a"), (3, 1, "B", "b"), (4, 0, "", "b")]
    assert [(r["page_id"], r["section"], r["title"], r["content"]) for r in html.page_sections(df).collect()] == a
    outer = [(None, None, None, None, None, None), (2**53 + 1, None, None, None, "", False), *((*r, "a&amp", True) for r in a[:2]), (*a[2], "", True)]
    assert [tuple(r) for r in html.page_sections(df, outer=True).drop("anchor").collect()] == outer


def test_tables(spark, tmp_path):
    y = tmp_path / "r.yaml"
    y.write_text("a: [{source_url: u, source_page_title: t, content: c}]\nb: [{source_url: v}]\n")
    assert tables.resources_from_yaml(spark, str(y), ("a",)).count() == 1
    root = str(tmp_path / "c")
    assert tables.read_collection(spark, root, "hotel").count() == 0
    for n in (2, 1):
        tables.refresh(spark.createDataFrame([(str(i), "u", "t", "c") for i in range(n)], tables.PAGE), root, "hotel")
        assert tables.read_collection(spark, root, "hotel").count() == n
    with pytest.raises(ValueError):
        tables.read_collection(spark, root, "nowhere")
    tree = '[{"course_id":1,"course_fullname":"c","sections":[{"id":2,"summary":"s","modules":[{"id":3,"name":"m","modname":"x","contents":null}]}]}]'
    assert tables.course_tree(spark.createDataFrame([(tree,)], "body string")).first()["contents"] == []


def test_incremental_index(spark, tmp_path):
    from siftwell.streaming.refresh import index_stream

    incoming, index = str(tmp_path / "in"), str(tmp_path / "index")
    embed = models.embedder()
    for rows in ([("1", "u", "t", "old words"), ("2", "u", "t", "more")], [("1", "u", "t", "new words")]):
        spark.createDataFrame(rows, tables.PAGE).write.mode("append").parquet(incoming)
        index_stream(spark, incoming, index, str(tmp_path / "state"), "hotel", embed).awaitTermination()
    got = {r["mongo_id"]: r["content"].splitlines()[-1] for r in spark.read.parquet(index).collect()}
    assert got == {"1": "new words", "2": "more"}


def test_whole_retrieval(spark):
    embed = models.embedder()
    rows = spark.createDataFrame([(1, "hotel", "a", "dorm quiet hours"), (2, "hotel", "a", "dorm rooms"), (3, "maps", "b", "library floor"), (4, "maps", "c", None)], "chunk_id long, resource string, mongo_id string, content string")
    asked = spark.createDataFrame([(1, "quiet dorm")], "query_id long, query string")
    got = ranking.retrieve(embed(rows, "content"), asked, embed, models.overlap_reranker, limit=5).orderBy("final_rank").collect()
    assert [(r["mongo_id"], r["score"]) for r in got] == [("a", 1.0)]


def test_texts_of_handbooks_and_headers(spark):
    assert one(spark, "- a <br> <br>b  c<br>d<br>\nx - y<br>z\n-q\n- <br>", tx.joined_bullets) == "- a: b c. d\nx - y: z\n-q\n-"
    assert one(spark, "a\xa0[ | x\n | ](u) b \\| c ", tx.without_link_pipes) == "a  b | c"
    assert [one(spark, x, tx.bearer_token) for x in ("Bearer t u", "bearer t", "Basic t", "Bearer ", "Bearer", None)] == ["t u", "t", None, None, None, None]
    assert [one(spark, x, tx.capitalised) for x in ("ENGLISH", "r", "")] == ["English", "R", ""]
    assert one(spark, "2025-01-02T03:04:05+01:00", lambda c: tx.iso_time(c).cast("long")) == 1735783445 and one(spark, "x", tx.iso_time) is None
    assert one(spark, "2025-01-02T03:04:05", lambda c: tx.day_text(tx.iso_time(c))) == "2025-01-02 Thursday"


def test_wiki_sections():
    toc = '<div id="toc" class="toc"><ul><li><a href="#A">1 A</a><ul><li><a href="#A1">1.1 Part: one</a></li></ul></li><li><a href="/p#B">2 B</a></li></ul></div>'
    body = '<h2><span class="mw-headline" id="A">A</span></h2><p>none</p><h3><span class="mw-headline" id="A1">A1</span></h3><p>x</p><div class="noprint">no</div><img src=i><h2><span class=mw-headline id="B">B</span></h2><table><tr><th>h<th>k<tr><td>a<td>b</table>'
    page = f'<h1 id="firstHeading">Title</h1><div class="mw-body other">{toc}{body}</div>'
    assert html.wiki_sections(page, "u") == [("u#A1", "Part: one", "### A1\n\nx"), ("u#B", "B", "## B\n\n- a\n\t- k: b")]
    assert html.wiki_sections('<h1 id="firstHeading">T</h1><div class="mw-body"><p>x</div>y', "u") == [("u", "T", "x")]


def test_handbook_sections(spark):
    page = '<header>no</header><a href="#one"> One </a><a href="#two">Two</a><div id=r1><a name="one"></a></div><div><div class="t-title_xxl t-title">Big</div><div class="PersonWrapper">no</div><div class="t1-col-wrapper">k<br><a href="l"> t </a><div>z<div class="x personwrapper">no</div></div></div></div><div id=r2><a name="two"></a></div><div class="t431"><div class="t431__data-part1">h1;h2</div><div class="t431__data-part2">a;b\n;\nc;d;e</div></div>'
    rows = html.page_rows(spark.createDataFrame([("u", page)], "url string, html string"), "handbook").collect()
    assert [tuple(r) for r in rows] == [("u#one", "One", "## Big\n\n- k: [t](l). z"), ("u#two", "Two", "- a\n\t- h2: b\n- c\n\t- h2: d")]


def test_site_sections(spark):
    page = '<div class="Landing-Header">no</div><div id="a"><h2> First </h2><h3> </h3><p>x • y</div><div>more <a href="/p q">l</a></div><div id="b"><div><h2>Second</h2></div>z</div><div id="c"><h2>Empty</h2></div>'
    rows = html.page_rows(spark.createDataFrame([("https://h.org/p", page), ("https://h.org/q", "<p>no")], "url string, html string"), "site").collect()
    assert [tuple(r) for r in rows] == [("https://h.org/p#a", "FIRST", "# FIRST\n\nx \n* y\n\nmore [l](https://h.org/p%20q)"), ("https://h.org/p#b", "SECOND", "# SECOND\n\nz")]


def test_residents(spark):
    detail = "<h1> Acme </h1><div><h2>Сфера деятельности</h2><p>makes</p><p>things</p></div><div class=props><div><b>Phone</b> 12</div><div>mail</div></div>"
    rows = html.page_rows(spark.createDataFrame([("u", detail)], "url string, html string"), "resident")
    assert rows.first()["content"] == "# Acme\n\nmakes\nthings\n- Phone 12\n- mail"
    assert html.list_page(rows.unionByName(rows.withColumn("source_url", F.lit("a")).withColumn("source_page_title", F.lit("Zed"))), "All", "l").first()["content"] == "# All\n\nZed\nAcme"
    assert html.resident_page("", "u", "Name") == [("u", "Name", "# Name\n\n")]


def test_fetched_pages(spark):
    from siftwell.sources import fetch

    site = {
        "https://r.org/list": '<div class="ws512PN"><a>1</a><a>2</a></div><a class="newsSliderItem" href="/x"><span> X </span></a>',
        "https://r.org/list?PAGEN_1=2": '<a class="newsSliderItem" href="https://o.org/y"><span>Y</span></a>',
        "https://r.org/x": "<h1>X</h1>",
    }

    def get(url):
        return 200 if url != "https://r.org/x" else 404, site[url]

    assert sorted(tuple(r) for r in fetch.listed(spark, "https://r.org/list", get).collect()) == [("https://o.org/y", "Y"), ("https://r.org/x", "X")]
    got = {r["url"]: (r["html"], r["error"]) for r in fetch.pages(spark.createDataFrame([("https://r.org/list?PAGEN_1=2",), ("https://r.org/x",), ("https://r.org/none",), (None,)], "url string"), get).collect()}
    assert got["https://r.org/x"] == (None, "status 404") and got["https://r.org/none"][0] is None and len(got) == 3 and got["https://r.org/list?PAGEN_1=2"][1] is None


def test_one_row_type(spark):
    hits = spark.createDataFrame([(1, "moodle", "m", 0.7), (1, "eduwiki", "w", 0.9), (1, "maps", "p", 0.8), (1, "resources", "r", 0.1), (1, "eduwiki", "gone", 1.0)], "query_id long, resource string, mongo_id string, score double")
    page = lambda i, *more: spark.createDataFrame([(i, "u", "t", "a\n\nbody", *more)], "id string, source_url string, source_page_title string, content string" + ", resource_type string" * bool(more))
    maps = spark.createDataFrame([("p", "mu", "s", "a", "x\n\nroom", "108")], tables.MAP)
    entry = spark.createDataFrame([("m", 1, "C / x", 2, "s", 3, "mod", "z", [("file", "f", 0, 0, False)])], tables.COURSE_MODULE)
    rows = hydrate.hydrate(hits, {"moodle": entry, "eduwiki": page("w"), "maps": maps, "resources": page("r", "ithelp")}).collect()
    assert [(r["type"], r["score"], r["display_name"], r["preview_text"]) for r in rows] == [("eduwiki", 0.9, "t", "body"), ("maps", 0.8, "108", "room"), ("moodle-file", 0.7, "mod", None), ("resources", 0.1, "t", "body")]
    assert rows[1]["url"] == "mu" and rows[2]["object_key"] == "moodle/1/3/f" and rows[3]["resource_type"] == "ithelp"
    plain = hydrate.hydrate(hits, {"eduwiki": page("w").withColumn("content", F.lit("<b>x</b>")), "maps": maps}, "lexical").collect()
    assert [r["preview_text"] for r in plain] == ["x", "x\n\nroom"]


def test_index_of_empty_sources(spark, tmp_path):
    path = str(tmp_path / "index")
    assert chunking.read_index(spark, path, ["hotel"]).count() == 0
    embed = models.embedder()
    docs = spark.createDataFrame([("1", "u", "t", "some words")], tables.PAGE)
    none = embed(chunking.index_rows(docs.limit(0), "hotel"), "content")
    assert chunking.write_index(none, path, "hotel").count() == 0
    for name in ("hotel", "clubs"):
        chunking.write_index(embed(chunking.index_rows(docs, name), "content"), path, name)
    assert chunking.write_index(none, path, "hotel").count() == 1
    assert [r["resource"] for r in chunking.read_index(spark, path, ["hotel", "clubs", "maps"]).collect()] == ["clubs"]
    rooms = spark.createDataFrame([("p", 'u"', "s", "a", "<b>x</b>", "108"), ("q", None, "s", "a", "y", "109")], tables.MAP)
    got = [r["content"] for r in chunking.index_rows(rooms, "maps").orderBy("mongo_id").collect()]
    assert got[0].startswith('<chunk chunk_number=0 location_url="u&quot;" hint="') and got[0].endswith('">x') and got[1] == "y"


def test_refresh_that_was_stopped(spark, tmp_path):
    root = str(tmp_path / "c")
    tables.refresh(spark.createDataFrame([("1", "u", "t", "c")], tables.PAGE), root, "hotel")
    (tmp_path / "c" / "hotel").rename(tmp_path / "c" / ".hotel-former-x")
    assert tables.read_collection(spark, root, "hotel").count() == 1
    tables.refresh(spark.createDataFrame([("1", "u", "t", "c"), ("2", "u", "t", "c")], tables.PAGE), root, "hotel")
    assert tables.read_collection(spark, root, "hotel").count() == 2 and not list((tmp_path / "c").glob(".hotel-*"))


def test_logs_prompts_and_answers(spark, tmp_path):
    asked = spark.createDataFrame([(1, "q one"), (2, "and two?")], "query_id long, query string")
    results = spark.createDataFrame([(1, 1, "a", 0.9), (1, 2, "b", 0.8)], "query_id long, final_rank int, source string, score double")
    rows = logs.log_rows(results, logs.timed(lambda: asked))
    logs.append(rows, str(tmp_path / "log"))
    logs.append(rows, str(tmp_path / "log"))
    got = spark.read.parquet(str(tmp_path / "log")).where("id = 1").collect()
    assert len(got) == 2 and [x["source"] for x in got[0]["wrapped_responses"]] == ["a", "b"] and got[0]["time_spent"] > 0
    told = spark.createDataFrame([(2, "user: q one")], "query_id long, history string")
    new = {r["query_id"]: r for r in logs.rewritten(asked, told, lambda prompts: [" " + p.split("Follow Up Input: ")[1].split("\n")[0].upper() + ("!" if "Chat History:\nuser: q one\n" in p else "") for p in prompts]).collect()}
    assert (new[1]["query"], new[2]["query"], new[2]["original"]) == ("Q ONE", "AND TWO?!", "and two?")
    assert {r["query"] for r in logs.rewritten(asked, told).collect()} == {"q one", "and two?"}
    answers = logs.completed(asked, "query", "answer", lambda prompts: [f"re {p}" for p in prompts]).withColumn("time_spent", F.lit(0.5))
    assert sorted(r["responses"] for r in logs.answer_rows(answers, ["query", "answer"]).collect())[1] == '{"query":"q one","answer":"re q one"}'
    with pytest.raises(Exception, match="no answer"):
        logs.completed(asked, "query", "answer", lambda prompts: [None] * len(prompts)).collect()
    assert logs.sources_or_default(None) == list(logs.DEFAULT_SOURCES) and logs.sources_or_default(["maps"]) == ["maps"]
    m = asked.select(logs.messages(F.array(F.struct(F.lit("user").alias("role"), F.lit("h").alias("content"))), F.lit("p"), F.col("query"), F.lit("q one")).alias("m")).collect()
    assert [len(r["m"]) for r in m] == [1, 2]
    assert one(spark, "Sorry, no", lambda c: F.size(logs.gate_results(c, F.array(F.lit(1)))), "string") == 0


def test_few_rows_each(spark, tmp_path):
    entries = spark.createDataFrame([("m", 1, "C / x", 2, "s", 3, "mod", "z", [("file", "f", 0, 0, False), ("url", "g", 0, 0, False)]), ("n", 2, "D", 2, "s", 4, "mod", "z", [])], tables.COURSE_MODULE)
    assert sorted(r["filename"] for r in lms.course_sources(entries, "C / x").collect()) == ["f", "g"]
    assert metrics.means(metrics.evaluate(spark.createDataFrame([([1, 0],), ([0, 1],)], "rel array<int>"))).first()["rr"] == 0.75
    (tmp_path / "e.csv").write_text('Question,Link\n"a, b","u1\nu2 "\nc,\n')
    assert [(r["query"], r["expected"]) for r in tables.evaluation_sheet(spark, str(tmp_path / "e.csv"), "Question", "Link").collect()] == [("a, b", ["u1", "u2"]), ("c", None)]
    for d in ("moodle/1/2", "other"):
        (tmp_path / "blobs" / d).mkdir(parents=True)
        (tmp_path / "blobs" / d / "f.pdf").write_bytes(b"xyz")
    got = tables.list_objects(spark, str(tmp_path / "blobs"))
    assert [tuple(r) for r in tables.parse_object_paths(got).collect()] == [(1, 2, "f.pdf")]
    tables.dump_markdown(spark.createDataFrame([("p.md", "# t\nx")], "file string, content string"), str(tmp_path / "md"))
    assert [p.read_text() for p in (tmp_path / "md" / "file=p.md").glob("part-*")] == ["# t\nx\n"]
