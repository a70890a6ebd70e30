"""JSON feeds as documents: map areas and clubs, all in expressions; and delimited tables as lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import escape_underscores

SCENES = "array<struct<scene_id:string,title:string,areas:array<struct<title:string,svg_polygon_id:string,description:string,people:array<string>>>>>"
CLUBS = "array<struct<id:string,title:string,short_description:string,type:string,links:array<struct<type:string,link:string>>>>"
#: Labels of the link kinds that a club's text shows; fixed values.
LINK_LABELS = {"telegram_channel": ("Telegram channel", "see"), "telegram_chat": ("Telegram chat", "join"), "external_url": ("Website", "check")}


def map_documents(bodies: DataFrame, col: str = "body", base_url: str = "https://maps.example.org") -> DataFrame:
    """A document for each area: scene, area, description with hard line breaks, every second of the people."""
    scene = bodies.select(F.explode(F.from_json(col, SCENES)).alias("s"))
    a = scene.select("s.scene_id", F.col("s.title").alias("scene"), F.explode("s.areas").alias("a"))
    described = F.when(F.coalesce(F.col("a.description"), F.lit("")) != "", F.concat(F.lit("**Description:** "), F.replace("a.description", F.lit("\n"), F.lit("  \n")), F.lit("  \n")))
    people = F.when(F.size("a.people") > 0, F.concat(F.lit("**People:** "), F.array_join(F.filter("a.people", lambda _, i: i % 2 == 0), ", "), F.lit("  \n")))
    content = F.concat(F.lit("# "), F.col("scene"), F.lit("\n### "), F.col("a.title"), F.lit("\n"), F.coalesce(described, F.lit("")), F.coalesce(people, F.lit("")))
    preposition = F.when(F.lower("scene").startswith("floor"), " on ").otherwise(" in ")
    url = F.concat(F.lit(f"{base_url}?scene="), F.col("scene_id"), F.lit("&area="), F.col("a.svg_polygon_id"))
    return a.select(url.alias("location_url"), "scene_id", F.col("a.svg_polygon_id").alias("area_id"), F.regexp_replace(content, r"(?U)\s+$", "").alias("content"), F.concat(F.col("a.title"), preposition, F.col("scene")).alias("title"))


def club_documents(bodies: DataFrame, leaders: DataFrame, col: str = "body") -> DataFrame:
    """(id, position, type, title, content): clubs with their leader, where there is one, and known links."""
    c = bodies.select(F.posexplode(F.from_json(col, CLUBS)).alias("position", "c")).select("position", "c.*").join(leaders.select(F.col("club_id").alias("id"), "name", "telegram_alias"), "id", "left")
    alias = escape_underscores(F.col("telegram_alias"))
    leader = F.when(F.col("name").isNotNull(), F.concat(F.lit("\n\n**Club leader:** "), F.col("name"), F.coalesce(F.concat(F.lit(" [@"), alias, F.lit("](https://t.me/"), alias, F.lit(")")), F.lit(""))))

    def shown(x: Column) -> Column:
        out = None
        for kind, (label, verb) in LINK_LABELS.items():
            text = F.concat(F.lit(f"\n\n**{label}:** [{verb}]("), escape_underscores(x["link"]), F.lit(")"))
            out = F.when(x["type"] == kind, text) if out is None else out.when(x["type"] == kind, text)
        return out

    links = F.array_join(F.filter(F.transform("links", shown), lambda t: t.isNotNull()), "")
    return c.select("id", "position", "type", "title", F.concat(F.lit("# "), F.col("title"), F.lit("\n"), F.coalesce("short_description", F.lit("")), F.coalesce(leader, F.lit("")), F.coalesce(links, F.lit(""))).alias("content"))


def table_to_list(headers: Column, body: Column) -> Column:
    """A ``;`` table as a nested list: rows padded or cut to the headers, empty cells left out, empty rows too."""
    names = F.filter(F.transform(F.split(headers, ";", -1), lambda h: F.trim(h)), lambda h: h != "")
    rows = F.filter(F.transform(F.split(F.trim(body), "\n", -1), lambda r: F.transform(F.split(r, ";", -1), lambda c: F.trim(c))), lambda cols: F.exists(cols, lambda c: c != ""))
    shaped = F.transform(rows, lambda cols: F.slice(F.concat(cols, F.array_repeat(F.lit(""), F.size(names))), F.lit(1), F.size(names)))
    cell = lambda c, i: F.when((i > 0) & (c != ""), F.concat(F.lit("\t- "), F.get(names, i), F.lit(": "), c, F.lit("\n"))).otherwise("")
    return F.array_join(F.transform(shaped, lambda cols: F.concat(F.lit("- "), F.get(cols, F.lit(0)), F.lit("\n"), F.array_join(F.transform(cols, cell), ""))), "")
