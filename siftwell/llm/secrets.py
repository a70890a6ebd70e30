"""Secret scans (7): patterns propose spans; how many owners and repositories share a value tells copied examples from live credentials.

Each value is hashed; distinct (hash, owner) and (hash, repository) pairs are counted over the whole corpus. A value with at
most ``most_owners`` owners and in at most ``most_repositories`` repositories looks live; one that is spread wider over either
is a copied example, also where a single owner holds all its copies. ``counts`` has both numbers of every proposed span. The base kinds (assign, access, hex) always
stay; the method adds spans of provider formats and of generic mixed tokens, where their value looks live and no base span
covers them. Only hashes leave the scan, so values are never shuffled or stored.

Null texts count as empty; null owners are one owner, null repositories one repository; repeated rows are scanned each and
are one repository; long texts are scanned whole, in time that grows with their length; spans of equal start are in order of
kind; an empty table gives no rows. Counting first sums distinct pairs within each task, and the counts of values with many
rows are sent to these, so a value that a third of all rows hold is no hot spot. Positions are code points, ends exclusive.
Other columns are not read, and ids are passed on as they are.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import map_rows, written

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Formats beside the base kinds, and a piece of text without which each has no match.
FORMATS = (
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), "gh"),
    ("slack", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), "xox"),
    ("stripe", re.compile(r"sk_(?:live|test)_[A-Za-z0-9]{16,}"), "sk_"),
    ("google", re.compile(r"AIza[0-9A-Za-z_-]{35}"), "AIza"),
    # begins only where a run does and keeps what it took, so that a long run is read once
    ("jwt", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]+"), "eyJ"),
    ("mixed", re.compile(r"[A-Za-z0-9+/_-]{24,}"), ""),
)
KINDS = ("assign", "access", "hex", *(name for name, _, _ in FORMATS))
N_BASE = 3


def entropy(value: str) -> float:
    """Bits a character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def _looks_random(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.isupper() for c in value) and any(c.islower() for c in value) and entropy(value) >= 3.5


def _union(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _meets(spans: list[tuple[int, int]], starts: list[int], start: int, end: int) -> bool:
    """Whether one of the ordered spans overlaps start to end."""
    k = bisect.bisect_left(starts, end) - 1
    return k >= 0 and spans[k][1] > start


def propose(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base spans and of the method's candidates, by start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS) or not low.isascii():
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    taken = _union((a, b) for a, _, b, _ in out)
    starts = [a for a, _ in taken]
    for k, (name, pattern, piece) in enumerate(FORMATS, N_BASE):
        if piece in text:
            for m in pattern.finditer(text):
                if (name != "mixed" or _looks_random(m[0])) and not _meets(taken, starts, m.start(), m.end()):
                    out.append((m.start(), k, m.end(), m[0]))
    return sorted(out)


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in spans)


#: Rows from which on a value's counts are sent to its rows instead of being joined by a shuffle of them, and how many values
#: can be sent at most: one needs at least that share of all spans, so the bound holds for any input (some 20 MB).
HOT_ROWS, MOST_HOT = 10_000, 100_000
_SPAN = "struct<start:int,kind:int,end:int,hash:binary>"


def scan(docs: DataFrame, owner_col: str = "source", repository_col: str = "doc_id") -> DataFrame:
    """A row for each document: counts, the base digest and all proposed spans with their values' hashes."""

    def make():
        part, n = TaskContext.get().partitionId(), itertools.count()

        def run(texts: list[str | None]) -> tuple[list, ...]:
            rows, counts, digests, found = [], [], [], []
            for text in texts:
                spans = propose(text or "")
                base = [s for s in spans if s[1] < N_BASE]
                rows.append(f"{part}-{next(n)}")
                counts.append([sum(s[1] == k for s in base) for k in range(N_BASE)])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                found.append([{"start": a, "kind": k, "end": b, "hash": hashlib.blake2b(v.encode("utf-8", "replace"), digest_size=16).digest()} for a, k, b, v in spans])
            return rows, *([c[k] for c in counts] for k in range(N_BASE)), digests, found

        return run

    kept = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repository_col).cast("string"), F.lit("")).alias("repository")]
    return map_rows(docs, kept, ["text"], f"row string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<{_SPAN}>", make)


def find(docs: DataFrame, owner_col: str = "source", repository_col: str = "doc_id", most_owners: int = 2, most_repositories: int = 10, hot_rows: int = HOT_ROWS, most_hot: int = MOST_HOT) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, counts).

    ``counts`` has kind:start:end:owners:repositories of every proposed span, copied ones included.
    """
    seen = written(scan(docs, owner_col, repository_col), "secrets")
    each = seen.where(F.size("found") > 0).select("row", "owner", "repository", F.explode("found").alias("s")).select("row", "owner", "repository", "s.*")
    # distinct pairs first, each summed within its task, then a count for each value; the counts are written, as two joins read them
    owners = each.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("owners"))
    repositories = each.select("hash", "repository").distinct().groupBy("hash").agg(F.count("*").alias("repositories"))
    rows = each.groupBy("hash").agg(F.count("*").alias("rows"))
    spread = owners.join(repositories, "hash").join(rows, "hash").select("hash", ((F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)).alias("live"), "owners", "repositories", "rows")
    spread = written(spread, "spread")
    # a value in that many rows, of which there are most_hot at most, is sent to where its rows are
    least = max(hot_rows, -(-(spread.agg(F.sum("rows")).first()[0] or 0) // most_hot))
    hot = F.broadcast(spread.where(F.col("rows") >= least))
    known = each.join(hot, "hash").unionByName(each.join(hot.select("hash"), "hash", "left_anti").join(spread.where(F.col("rows") < least), "hash"))
    kinds = F.array(*(F.lit(k) for k in KINDS))
    judged = known.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when((F.col("kind") < N_BASE) | F.col("live"), F.struct("start", "kind", "end")))).alias("kept"),
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "owners", "repositories"))).alias("all"),
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((~F.col("live")).cast("long")).alias("n_copied"),
    )
    text = lambda c, *more: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), *(x[k].cast("string") for k in ("start", "end", *more)))), ","), F.lit(""))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return seen.join(judged, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text("kept").alias("spans"), zero("n_live"), zero("n_copied"), text("all", "owners", "repositories").alias("counts"))
