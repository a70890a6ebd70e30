"""HTML to text and sections with the standard library's parser, in Arrow batches; unclosed tags are tolerated."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as tx
from siftwell.session import ship

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that leave nothing; fixed values.
DROPPED = frozenset("script style noscript iframe footer img".split())
BLOCK = frozenset("p div section article ul ol table tr h1 h2 h3 h4 h5 h6 header nav main body".split())
#: What an open element of the first kind ends at.
CLOSES = {"p": BLOCK | {"li"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in DROPPED:
                stack += reversed(n.children)
        return "".join(out)


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        while self.at.tag in CLOSES and tag in CLOSES[self.at.tag]:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)

    def parse_marked_section(self, i, report=1):
        """Unknown ones (``<![x[``) are comments, as browsers take them, in place of the parser's error."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)


def parse(html: str) -> Node:
    t = Tree()
    t.feed(html or "")
    t.close()
    return t.root


def markdown(node: Node) -> str:
    """Headings, lists, links, tables as nested lists, paragraphs; dropped elements leave nothing."""
    top: list[str] = []
    # open elements with what their children gave so far: unclosed tags nest deeper than calls can
    stack = [(None, iter([node]), top)]
    while stack:
        n, rest, parts = stack[-1]
        for c in rest:
            if isinstance(c, str):
                parts.append(c)
            elif c.tag == "br":
                parts.append("\n")
            elif c.tag == "table":
                parts.append(table_list(c))
            elif c.tag not in DROPPED:
                stack.append((c, iter(c.children), []))
                break
        else:
            stack.pop()
            if stack:
                stack[-1][2].append(wrapped(n, "".join(parts)))
    return "".join(top)


def wrapped(node: Node, inner: str) -> str:
    """An element's Markdown, from that of its children."""
    tag = node.tag
    if re.fullmatch("h[1-6]", tag):
        title = " ".join(inner.split())
        return f"\n\n{'#' * int(tag[1])} {title}\n\n" if title else ""
    if tag == "li":
        return f"\n- {inner.strip()}"
    if tag == "a" and node.attrs.get("href"):
        return f"[{inner.strip()}]({node.attrs['href']})"
    if tag in ("b", "strong"):
        bold = inner.strip()
        return f"**{bold}**" if bold else ""
    return f"\n\n{inner}\n\n" if tag in BLOCK else inner


def table_list(table: Node) -> str:
    """Rows below the first as items, their other cells beneath under the first row's names; extra cells keep no name."""
    rows = [[" ".join(c.text().split()) for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in table.walk() if r.tag == "tr"]
    rows = [r for r in rows if r]
    if len(rows) < 2:
        return "\n".join(f"- {c}" for r in rows for c in r)
    head, out = rows[0], ["\n"]
    for r in rows[1:]:
        out.append(f"- {r[0]}")
        out += [f"\t- {head[i]}: {c}" if i < len(head) else f"\t- {c}" for i, c in enumerate(r[1:], 1) if c]
    return "\n".join(out) + "\n"


HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Classes of a wiki page's parts that are no content, of a site's frame, of persons' cards and of flattened blocks; fixed values.
WIKI_IGNORED = frozenset(("printfooter", "noprint", "mw-jump-link"))
FRAME_CLASSES = ("landing-footer", "landing-header")
PERSON_CLASS = "personwrapper"
BLOCK_CLASSES = ("col-wrapper", "sectioninfowrapper")
TITLE_CLASSES = ("t-title", "title_xxl", "title_xl", "t-card__title")
#: The heading above what a resident does; fixed value.
ACTIVITY = "Сфера деятельности"


def classes(node: Node) -> list[str]:
    return node.attrs.get("class", "").split()


def any_class(node: Node, parts: tuple[str, ...]) -> bool:
    """Whether a class of the element contains one of ``parts``, in either case."""
    return any(p in c.lower() for c in classes(node) for p in parts)


def all_of(root: Node, *tags: str) -> list[Node]:
    return [n for n in root.walk() if n.tag in tags]


def drop(nodes: list[Node]) -> None:
    for n in nodes:
        n.parent.children = [c for c in n.parent.children if c is not n]


def following(node: Node) -> Iterator[Node]:
    """The elements behind this one under the same parent."""
    at = next(k for k, c in enumerate(node.parent.children) if c is node)
    yield from [c for c in node.parent.children[at + 1 :] if isinstance(c, Node)]


def line(node: Node) -> str:
    return " ".join(node.text().split())


def wiki_sections(html: str, url: str) -> list[tuple[str, str, str]]:
    """(source_url, title, content) of a wiki page: its table of contents' innermost entries with what stands from their
    headings to the next one's; a page without such a table is one row."""
    root = parse(html)
    title = next((line(n) for n in root.walk() if n.attrs.get("id") == "firstHeading"), "Untitled")
    body = next((n for n in all_of(root, "div") if "mw-body" in classes(n)), root)
    toc = next((n for n in all_of(body, "div") if n.attrs.get("id") == "toc" and "toc" in classes(n)), None)
    named = {}
    for li in all_of(toc, "li") if toc else ():
        link = next((a for a in all_of(li, "a") if "#" in a.attrs.get("href", "")), None)
        if link is not None and not all_of(li, "ul"):
            named[link.attrs["href"].split("#")[1]] = link.text()
    pivots = {}
    for h in all_of(body, *HEADINGS):
        mark = next((s.attrs["id"] for s in all_of(h, "span") if "mw-headline" in classes(s) and "id" in s.attrs), None)
        if mark in named:
            pivots.setdefault(mark, h)
    starts = {id(h) for h in pivots.values()}
    drop([n for n in body.walk() if n.parent is not None and WIKI_IGNORED.intersection(classes(n))])
    if toc is None:
        return [(url, title, tidy(markdown(body)))]
    out = []
    for mark, h in pivots.items():
        rest = itertools.takewhile(lambda n: id(n) not in starts, following(h))
        content = tidy("".join(markdown(n) for n in (h, *rest)))
        out.append((f"{url}#{mark}", re.sub(r"^[\s:.0-9]+", "", named[mark]), content))
    return out


def flattened(node: Node) -> list[str]:
    """A block line by line: texts, links with a text, an empty line for each break, inner blocks in their place; no persons."""
    out, stack = [], [iter(node.children)]
    while stack:
        for c in stack[-1]:
            if isinstance(c, str):
                out += [c.strip()] if c.strip() else []
            elif any_class(c, (PERSON_CLASS,)):
                continue
            elif c.tag == "br":
                out.append("")
            elif c.tag == "a" and c.attrs.get("href"):
                href, text = c.attrs["href"].strip(), c.text().strip()
                out += [f"[{text}]({href})"] if href and text else []
            elif c.tag == "div":
                stack.append(iter(c.children))
                break
        else:
            stack.pop()
    return out


def handbook_sections(html: str, url: str) -> list[tuple[str, str, str]]:
    """(source_url, title, content) of a page that is cut by named anchors: those that links of the page lead to, with
    what follows each up to the next. ``content`` is raw Markdown, for ``without_link_pipes``."""
    root = parse(html)
    drop([n for n in root.walk() if n.tag in ("header", "img") or n.parent is not None and any_class(n, (PERSON_CLASS,))])
    for n in all_of(root, "div"):
        if any_class(n, TITLE_CLASSES) and 0 < len(line(n)) < 100:
            n.tag = "h2" if any_class(n, ("xxl",)) else "h3"
    for n in all_of(root, "div"):
        parts = [d for d in all_of(n, "div") if any(re.match(r"t\d+__data-part\d+", c) for c in classes(d))]
        if len(parts) > 1 and any(re.match(r"t\d+", c) for c in classes(n)) and n not in parts:
            n.children = ["\n" + delimited_list(parts[0].text(), parts[1].text()) + "\n"]
    for n in [n for n in root.walk() if any_class(n, BLOCK_CLASSES)]:
        lines = flattened(n)
        n.tag, n.children = "div", ["- " + "<br>  ".join(lines)] if lines else []
    named = {a.attrs["href"].strip()[1:]: line(a) for a in all_of(root, "a") if a.attrs.get("href", "").strip().startswith("#")}
    order = [n for n in root.walk()]
    places = {id(n): k for k, n in enumerate(order)}
    pivots = {}
    for a in all_of(root, "a"):
        if a.attrs.get("name") in named:
            pivots.setdefault(a.attrs["name"], a)
    anchors = {id(a) for a in pivots.values()}
    ends = lambda n: id(n) in anchors or any(id(c) in anchors for c in n.children)
    out = []
    for name, a in pivots.items():
        after = order[places[id(a)] + 1 : places[id(a)] + 2]
        blocks = itertools.takewhile(lambda n: not ends(n), itertools.chain(after, following(after[0]) if after else ()))
        out.append((f"{url}#{name}", named[name], tidy("".join(markdown(n) for n in blocks))))
    return out


def delimited_list(headers: str, body: str) -> str:
    """A ``;`` table as a nested list, its rows padded or cut to the headers."""
    names = [h.strip() for h in headers.split(";") if h.strip()]
    out = []
    for row in body.strip().split("\n"):
        cells = [c.strip() for c in row.split(";")]
        if any(cells):
            out.append(f"- {cells[0]}")
            out += [f"\t- {n}: {c}" for n, c in zip(names[1:], cells[1:], strict=False) if c]
    return "\n".join(out)


def cleaned(root: Node, domain: str) -> None:
    """Without frames, empty headings, and with absolute links; what ``markdown`` drops need not be taken out here."""
    drop([n for n in all_of(root, "div") if n.parent is not None and any_class(n, FRAME_CLASSES)])
    drop([h for h in all_of(root, *HEADINGS) if not h.text().strip()])
    for a in all_of(root, "a"):
        href = a.attrs.get("href")
        if href is not None:
            if not href.startswith(("http://", "https://", "mailto:", "tel:")):
                href = f"https://{domain}/{href.lstrip('/')}"
            a.attrs["href"] = href.replace(" ", "%20")


def site_sections(html: str, url: str) -> list[tuple[str, str, str]]:
    """(source_url, title, content) of a site's page: each h2 in capitals, with the block around it that has an id and the
    blocks behind it up to the next such one. Of equal titles the later counts, in the first one's place. ``content`` is raw
    Markdown below the title, for ``normalised_layout``; a page without such headings gives none."""
    root = parse(html)
    cleaned(root, urlparse(url).netloc)
    found: list[tuple[str, Node]] = []
    for h in all_of(root, "h2"):
        block = h.parent
        while block is not None and "id" not in block.attrs:
            block = block.parent
        if block is not None and h.text().strip():
            found.append((h.text().strip().upper(), block))
            drop([h])
    out = {}
    for k, (title, block) in enumerate(found):
        last = found[k + 1][1] if k + 1 < len(found) else None
        rest = itertools.takewhile(lambda n: n is not last, following(block))
        out[title] = (f"{url}#{block.attrs['id']}", title, tidy("".join(markdown(n) for n in (block, *rest))))
    return list(out.values())


def resident_page(html: str, url: str, name: str | None = None) -> list[tuple[str, str, str]]:
    """(source_url, title, content) of a resident's page: what it does, without the heading, then its contacts as a list."""
    root = parse(html)
    heading = next(iter(all_of(root, "h1")), None)
    title = heading.text().strip() if heading is not None else name or ""
    activity = next((h for h in all_of(root, "h2") if h.text() == ACTIVITY), None)
    block = activity.parent if activity is not None else None
    while block is not None and block.tag not in ("div", ""):
        block = block.parent
    lines = "\n".join(block_texts(block)).splitlines()[1:] if block is not None and block.tag == "div" else []
    inside = [p for props in all_of(root, "div") if "props" in classes(props) for p in all_of(props, "div") if p is not props]
    seen = set()
    contacts = [f"- {' '.join(block_texts(p))}" for p in inside if not (id(p) in seen or seen.add(id(p)))]
    return [(url, title, f"# {title}\n\n" + "\n".join([*lines, *contacts]))]


def block_texts(node: Node) -> list[str]:
    """The stripped texts within an element, in order."""
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out += [n.strip()] if n.strip() else []
        else:
            stack += reversed(n.children)
    return out


def card_links(html: str) -> tuple[int, list[tuple[str, str]]]:
    """The number of pages of a list, by its pager, and (name, href) of its cards."""
    root = parse(html)
    pager = next((d for d in all_of(root, "div") if "ws512PN" in classes(d)), None)
    last = [a.text().strip() for a in all_of(pager, "a")][-1:] if pager is not None else []
    cards = [(line(next(iter(all_of(a, "span")))), a.attrs["href"]) for a in all_of(root, "a") if "newsSliderItem" in classes(a) and "href" in a.attrs and all_of(a, "span")]
    return int(last[0]) if last and last[0].isdigit() else 1, cards


#: What each kind of page is read by, and what its raw Markdown goes through then.
READERS = {"wiki": (wiki_sections, None), "handbook": (handbook_sections, tx.without_link_pipes), "site": (site_sections, tx.normalised_layout), "resident": (resident_page, None)}


def page_rows(pages: DataFrame, kind: str) -> DataFrame:
    """(source_url, source_page_title, content) of pages (url, html) of one kind; a page that cannot be read gives no rows."""
    ship(pages.sparkSession)
    read, polish = READERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += read(html or "", url or "")
                except (ValueError, IndexError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["source_url", "source_page_title", "content"])

    found = pages.select("url", "html").mapInArrow(run, "source_url string, source_page_title string, content string")
    if polish is not None:
        found = found.withColumn("content", polish(F.col("content"))).where(F.col("content") != "")
    if kind == "site":
        found = found.withColumn("content", F.concat(F.lit("# "), F.col("source_page_title"), F.lit("\n\n"), F.col("content")))
    return found


def list_page(rows: DataFrame, title: str, url: str) -> DataFrame:
    """One document that names all others: their titles in order of address, a line each."""
    named = rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source_url", "source_page_title"))), lambda x: x["source_page_title"]), "\n").alias("names"))
    return named.select(F.lit(url).alias("source_url"), F.lit(title).alias("source_page_title"), F.concat(F.lit(f"# {title}\n\n"), F.col("names")).alias("content"))


def tidy(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*(?=\n)", "\n", text)).strip()


def sections(html: str, heading: str = "h2") -> list[tuple[str, str, str]]:
    """(anchor, title, text) of each stretch between headings; a page without any is one section under its h1 or title.

    Of equal titles the later one stays; sections without text are left out.
    """
    root = parse(html)
    body = next((n for n in root.walk() if n.tag == "body"), root)
    heads = [n for n in body.walk() if n.tag == heading]
    if not heads:
        title = next((" ".join(n.text().split()) for t in ("h1", "title") for n in root.walk() if n.tag == t), "")
        text = tidy(markdown(body))
        return [("", title, text)] if text else []
    found: dict[str, tuple[str, str, str]] = {}
    parts, current = {}, None
    around = set()  # elements that hold a heading
    for h in heads:
        n = h.parent
        while n is not None and id(n) not in around:
            around.add(id(n))
            n = n.parent
    stack = [iter(body.children)]
    while stack:
        for c in stack[-1]:
            if isinstance(c, Node) and c.tag == heading:
                current = c
                parts[id(c)] = []
            elif isinstance(c, Node) and id(c) in around:
                stack.append(iter(c.children))
                break
            elif current is not None:
                parts[id(current)].append(c if isinstance(c, str) else markdown(c))
        else:
            stack.pop()
    for h in heads:
        title, text = " ".join(h.text().split()), tidy("".join(parts.get(id(h), [])))
        if text:
            found.pop(title, None)
            found[title] = (h.attrs.get("id") or (h.parent.attrs.get("id", "") if h.parent else ""), title, text)
    return list(found.values())


#: A title element as the source has it, and a source without anything but tags.
TITLE = re.compile("<title>([^<]*)</title>")
TAGS_ONLY = re.compile("(?:<[^>]++>)*+")


def as_written(html: str | None) -> tuple[str | None, bool | None]:
    """(title, has_text) of a page's source, not parsed: its first title element with references and white space left as
    they are, empty without one, and whether there is anything besides tags; nulls for null."""
    if html is None:
        return None, None
    title = TITLE.search(html)
    return title[1] if title else "", TAGS_ONLY.fullmatch(html) is None


def page_sections(pages: DataFrame, heading: str = "h2", outer: bool = False) -> DataFrame:
    """(page_id, section, anchor, title, content) of every page; a page that cannot be parsed gives no rows.

    With ``outer`` each row also has its page's (page_title, has_text) ``as_written``, and a page without sections, or one
    that cannot be parsed, is one row with nulls for the section.
    """
    ship(pages.sparkSession)
    schema = "page_id long, section int, anchor string, title string, content string" + ", page_title string, has_text boolean" * outer
    types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()] + [pa.string(), pa.bool_()] * outer
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = [(k, *s) for k, s in enumerate(sections(html, heading))]
                except ValueError:
                    found = []
                if outer:
                    source = as_written(html)
                    found = [(*s, *source) for s in found or [(None,) * 4]]
                rows += [(page, *s) for s in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, schema)
