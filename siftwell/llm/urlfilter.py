"""URL filters (3): longest-suffix rules first, then logistic regression on hashed character n-grams of host and path.

The regression is trained in numpy on a small labelled table of URLs that lies in this module; a rule, where one fits,
overrides it. Null urls and urls without ``://`` have an empty host and path, fit no rule and score by the bias alone.
Repeated rows are judged alike; an empty table gives no rows; columns other than id and url are not read. Of two rules the
longer text wins; equal ones cannot both fit.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import map_rows
from siftwell.llm.wordhash import code_points, mixed

BUCKETS = 1 << 14


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The contract's rules.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))

#: Labelled urls, one word a name: unwanted and ordinary hosts and paths. The training table is their product with UNWANTED_AT and ORDINARY_AT.
UNWANTED = "casino-win best-casino online-slots free-bets sports-betting lucky-poker cheap-pills viagra-shop buy-meds pharma-discount adult-x xxx-videos hot-cams sexy-chat spam-farm link-farm seo-links click-bait ads-track ad-server popunder-ads tracker-pixel free-prizes win-money payday-loans crypto-giveaway warez-crack keygen-download fake-watches replica-bags".split()
ORDINARY = "news weather library school university recipes gardening travel science history music museum football cycling kitchen family health blog forum docs wiki journal gazette market bakery village harbour mountain river castle theatre engineer teacher student community council railway station hotel airport weatherman archive gallery theory nature energy software hardware garden climate history people planet letters".split()
#: Where each name stands: the same places for both kinds, so that only the name tells them apart, and a path of its kind.
PLACES = ("{}.example.org/en/1234", "www.{}.example.net/de/99", "blog.{}.example.com/fr/7.html", "m.{}.example.net/es/5/", "{}.org/", "www.{}.com/about")
UNWANTED_AT = (*PLACES, "{}.test/bonus", "{}.test/promo")
ORDINARY_AT = (*PLACES, "{}.test/article", "{}.test/contact")


def labelled_urls() -> tuple[list[tuple[str, str]], list[int]]:
    """(host, path) and 1 for unwanted."""
    rows, labels = [], []
    for names, at, y in ((UNWANTED, UNWANTED_AT, 1), (ORDINARY, ORDINARY_AT, 0)):
        for name in names:
            for form in at:
                host, _, path = form.format(name).partition("/")
                rows.append((host, "/" + path.partition("?")[0]))
                labels.append(y)
    return rows, labels


def grams(parts: Sequence[str], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3- to 5-grams of each text with its ends, and which text each is of."""
    cp, ends = code_points([f"\x02{p}\x03" for p in parts])
    values = mixed(cp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))
    owner = np.repeat(np.arange(len(parts)), np.diff(ends))
    left = ends[1:][owner] - np.arange(len(cp))
    found, of = [], []
    for n in (3, 4, 5):
        ok = np.flatnonzero(left >= n)
        h = values[ok]
        for j in range(1, n):
            h = mixed(h) + values[ok + j]
        found.append((mixed(h + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int64))
        of.append(owner[ok])
    return np.concatenate(found), np.concatenate(of)


def features(rows: Sequence[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, rows and weights: host and path n-grams hash apart, and each part has weight 1 in all."""
    out = [grams([r[k] for r in rows], k + 1) for k in (0, 1)]
    weights = [1 / np.sqrt(np.maximum(1, np.bincount(of, minlength=len(rows))))[of] for _, of in out]
    return np.concatenate([g for g, _ in out]), np.concatenate([of for _, of in out]), np.concatenate(weights)


def train(rows: Sequence[tuple[str, str]], labels: Sequence[int], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3, caution: float = 2.0) -> tuple[np.ndarray, float]:
    y, (g, of, w) = np.array(labels, float), features(rows)
    weight = np.where(y > 0, 1.0, caution)  # an ordinary url that is blocked costs more than an unwanted one that is not
    theta, bias = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        slope = 1 / (1 + np.exp(-(np.bincount(of, theta[g] * w, len(y)) + bias))) - y
        slope *= weight / weight.mean()
        theta -= rate * (np.bincount(g, slope[of] * w, BUCKETS) / len(y) * 20 + decay * theta)
        bias -= rate * slope.mean()
    return theta, float(bias)


@functools.cache
def default_model() -> tuple[np.ndarray, float]:
    return train(*labelled_urls())


def host_of(url: Column) -> Column:
    """After the first ``://`` up to / ? # or the end; A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The text of the longest rule that fits, or null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, r.text) if out is None else out.when(fits, r.text)
    return F.lit(None).cast("string") if out is None else out


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, model: tuple[np.ndarray, float] | None = None, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): the score is the regression's, whether or not a rule decides."""
    theta, bias = model or default_model()

    def make():
        def run(hosts: list[str], paths: list[str]) -> tuple[np.ndarray]:
            g, of, w = features(list(zip(hosts, paths, strict=True)))
            return (1 / (1 + np.exp(-(np.bincount(of, theta[g] * w, len(hosts)) + bias))),)

        return run

    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scored = map_rows(split, ["page_id", "host", "path"], ["host", "path"], "score double", make)
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdicts = F.create_map(*(F.lit(x) for r in rules for x in (r.text, r.verdict))) if rules else F.create_map().cast("map<string,string>")
    by_score = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.withColumn("rule", rule).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.try_element_at(verdicts, F.col("rule"))).otherwise(by_score).alias("verdict"), "score")
