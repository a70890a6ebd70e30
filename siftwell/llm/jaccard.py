"""N-gram Jaccard join (4): vertical partitioning of the global shingle order.

Texts become sets of distinct 5-word shingles (64-bit hashes). The global order puts a quarter of the hash space first, rarest
shingles leading, and the rest behind it by hash. It is cut into fragments by hash. Two sets as similar as asked
share a shingle among the first ``n - ceil(0.8 n) + 1`` of either, so

1. each fragment counts, over all documents, how many different sets hold each of its shingles; a fragment of more than
   ``ENTRIES`` entries counts in parts, whose counts are summed;
2. each set keeps of its prefix what other sets hold too (most sets keep nothing and are done);
3. sets that share a kept shingle meet, if sizes and places allow a link. A bucket of more than ``LARGE`` sets gives a chain
   instead of pairs, and chains join to groups;
4. pairs are dealt to buckets by the least neighbour of one end, so that a clique stays together; the buckets' sets are cut into
   fragments, each counts the partial overlaps of the bucket's pairs, and these are summed per pair;
5. groups are compared in cells of at most two blocks of sets: a cell cuts its shingles into fragments, counts partial overlaps
   in each as a product of incidence matrices, and sums them; links leave as a spanning forest. Cells of one block and the
   group's pivots come first; only blocks that these have not joined meet after that.

Equal sets are one record from step 1 on. No step caps partners or drops frequent shingles: a large group only becomes
more cells. Nothing that grows with the corpus goes to the driver but counts.

Null, empty and wordless texts have size 0 and link with nothing; fewer than five words form one shingle. Rows with a null id
keep their size, link with nothing and have a null component. Repeated rows are equal sets. An empty table gives no rows;
columns other than id and text are not read. Two different shingles with one 64-bit hash count as equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.common import small_batches, written
from siftwell.llm.graph import components
from siftwell.llm.wordhash import code_points, lowered, mixed, space_words, span_hashes, spread
from siftwell.session import ship

#: Words a shingle, and the least similarity in hundredths.
WORDS = 5
PERCENT = 80
#: The share of the hash space that comes first in the order, and its end.
FRONT = 0.25
_FRONT_END = np.uint64(int(FRONT * 2**64))
#: Sets a block of a group, and sets of a bucket above which it becomes a chain instead of pairs.
BLOCK, LARGE = 2048, 256
#: Rows of ids, and places in lists of theirs, that may be broadcast: some 200 bytes each as a hash table, so 40 MB.
MOST_SENT = 200_000
#: Fragments that pairs are compared in, and shingles of a bucket of pairs (a set's count for each of its pairs).
CUTS, PAIRED = 8, 16_000_000
#: Entries of a fragment, and of a bucket of one shingle, above which it is split over tasks.
ENTRIES, HUGE = 4_000_000, 100_000
#: One set in so many of a block is a pivot of its group.
PIVOTS = 32
_COLUMNS = 4096


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    for a, b in small_batches(texts):
        cp, ends = code_points(texts[a:b])
        cp = lowered(cp)
        starts, lengths, at = space_words(cp, ends)
        words = span_hashes(cp, starts, lengths)
        rolled = np.zeros(len(words), np.uint64)
        for k in range(WORDS):  # a shingle that reaches past its text's end is cut off below
            rolled = mixed(rolled + np.uint64(k + 1))
            rolled[: max(0, len(words) - k)] += words[k:]
        rolled = mixed(rolled)
        for i in range(b - a):
            first, last = at[i], at[i + 1]
            if last - first >= WORDS:
                yield np.unique(rolled[first : last - WORDS + 1])
            elif last > first:
                h = np.array([last - first], np.uint64)
                for k in range(first, last):
                    h = mixed(h ^ words[k : k + 1])
                yield h
            else:
                yield np.zeros(0, np.uint64)


def record_id(found: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    place = mixed(np.arange(1, len(found) + 1, dtype=np.uint64))
    return int(mixed((found * (place | np.uint64(1))).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(found))).view(np.int64)[0])


def prefix_size(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


def emitted(found: np.ndarray) -> int:
    """How many of the sorted hashes a set brings to the fragments: the front of the order, and its prefix at least."""
    return max(int(np.searchsorted(found, _FRONT_END)), prefix_size(len(found)))


def scan(docs: DataFrame, n_fragments: int) -> DataFrame:
    """Rows with a size: (doc_id, n, front, rid). Rows with a fragment: its hashes, and whose they are, for a batch of documents."""
    ship(docs.sparkSession)

    schema = T._parse_datatype_string("doc_id long, n long, front long, rid long, fragment int, hashes binary, owners binary, names binary")
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def rows_of(size: int, **columns) -> pa.RecordBatch:
        arrays = [columns[name] if isinstance(columns.get(name), pa.Array) else pa.array(columns[name], t) if name in columns else pa.nulls(size, t) for name, t in zip(schema.names, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, fronts, names, parts, owners, known = [], [], [], [], [], {}
            for found in shingle_sets([t or "" for t in batch.column(1).to_pylist()]):
                sizes.append(len(found))
                fronts.append(int(np.searchsorted(found, _FRONT_END)))
                name = record_id(found) if len(found) else None
                names.append(name)
                if len(found) and name not in known:
                    known[name] = len(known)
                    take = found[: emitted(found)]
                    parts.append(take)
                    owners.append(np.full(len(take), known[name], np.uint32))
            yield rows_of(len(sizes), doc_id=batch.column(0), n=sizes, front=fronts, rid=names)
            if parts:
                h, owner = np.concatenate(parts), np.concatenate(owners)
                table = np.fromiter(known, np.int64, len(known))
                of = (h % np.uint64(n_fragments)).astype(np.int64)
                order = np.argsort(of, kind="stable")
                rows = []
                for f, at in zip(*_runs(of[order]), strict=True):
                    own, back = np.unique(owner[order[at]], return_inverse=True)
                    rows.append((f, h[order[at]].tobytes(), back.astype(np.uint16 if len(sizes) <= 65536 else np.uint32).tobytes(), table[own].tobytes()))
                fragment, hashes, held_by, of_sets = zip(*rows, strict=True)
                yield rows_of(len(rows), fragment=fragment, hashes=hashes, owners=held_by, names=of_sets)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _runs(sorted_keys: np.ndarray) -> tuple[list[int], list[slice]]:
    """The different keys and where each lies."""
    if not len(sorted_keys):
        return [], []
    first = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return sorted_keys[first].tolist(), [slice(a, b) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(sorted_keys)], strict=True)]


def _entries(hashes: list[bytes], owners: list[bytes], names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of some batches and the sets that hold them."""
    held = [np.frombuffer(h, np.uint64) for h in hashes]
    rids = [np.frombuffer(t, np.int64)[np.frombuffer(o, np.uint16 if len(o) == 2 * len(h) else np.uint32)] for h, o, t in zip(held, owners, names, strict=True)]
    return np.concatenate(held), np.concatenate(rids)


def _once(h: np.ndarray, rid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different entries, by hash and set."""
    order = np.lexsort((rid, h))
    h, rid = h[order], rid[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (rid[1:] != rid[:-1])]
    return h[new], rid[new]


def _held_by(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes: the first place of each, and how many there are of it."""
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return first, np.diff(np.r_[first, len(h)])


_SHARED = "bucket int, hashes binary, rids binary, held binary"


def _by_set(h: np.ndarray, rid: np.ndarray, held: np.ndarray, n_buckets: int) -> pd.DataFrame:
    """Entries that several sets hold, with how many do, dealt by set."""
    keep = held > 1
    h, rid, held = h[keep], rid[keep], held[keep]
    of = np.mod(rid, n_buckets)
    order = np.argsort(of, kind="stable")
    rows = [(b, h[order[at]].tobytes(), rid[order[at]].tobytes(), held[order[at]].astype(np.int64).tobytes()) for b, at in zip(*_runs(of[order]), strict=True)]
    return pd.DataFrame(rows, columns=["bucket", "hashes", "rids", "held"])


def shared_entries(pieces: DataFrame, n: int, most: int) -> DataFrame:
    """Entries that several sets hold, by set. A fragment of more than ``most`` entries, such as that of a shingle that a third of
    all sets hold, is split by set: its parts count alone, the counts are summed per hash and come back to the parts."""

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        h, rid = _once(*_entries(pdf["hashes"], pdf["owners"], pdf["names"]))
        held = _held_by(h)[1]
        return _by_set(h, rid, np.repeat(held, held), n)

    load = pieces.groupBy("fragment").agg((F.sum(F.octet_length("hashes")) / 8).alias("load")).where(F.col("load") > most)
    large = written(load.select("fragment", F.ceil(F.col("load") / most).cast("int").alias("parts")), "large")
    n_large = large.count()
    if not n_large:
        return pieces.groupBy("fragment").applyInPandas(whole, _SHARED)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for fragment, parts, *piece in pdf[["fragment", "parts", "hashes", "owners", "names"]].itertuples(index=False):
                h, rid = _entries(*([x] for x in piece))
                of = np.mod(rid >> 24, parts)
                order = np.argsort(of, kind="stable")
                rows += [(fragment, part, h[order[at]].tobytes(), rid[order[at]].tobytes()) for part, at in zip(*_runs(of[order]), strict=True)]
            yield pd.DataFrame(rows, columns=["fragment", "part", "hashes", "rids"])

    def part_of(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return _once(np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["hashes"]]), np.concatenate([np.frombuffer(x, np.int64) for x in pdf["rids"]]))

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        h, _ = part_of(pdf)
        first, held = _held_by(h)
        return pd.DataFrame({"fragment": pdf["fragment"].iloc[0], "part": pdf["part"].iloc[0], "h": h[first].view(np.int64), "held": held})

    def come_back(pdf: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        h, rid = part_of(pdf)
        names, held = totals["h"].to_numpy().view(np.uint64), totals["held"].to_numpy()
        order = np.argsort(names)
        at = np.minimum(np.searchsorted(names[order], h), max(0, len(names) - 1))
        several = names[order][at] == h if len(names) else np.zeros(len(h), bool)
        return _by_set(h[several], rid[several], held[order][at[several]], n)

    chosen = F.broadcast(large) if n_large <= MOST_SENT else large
    parts = written(pieces.join(chosen, "fragment").mapInPandas(split, "fragment int, part int, hashes binary, rids binary"), "parts")
    each = parts.groupBy("fragment", "part").applyInPandas(counted, "fragment int, part int, h long, held long")
    totals = each.withColumn("held", F.sum("held").over(Window.partitionBy("fragment", "h"))).where(F.col("held") > 1)
    back = parts.groupBy("fragment", "part").cogroup(totals.groupBy("fragment", "part")).applyInPandas(come_back, _SHARED)
    return pieces.join(chosen, "fragment", "left_anti").groupBy("fragment").applyInPandas(whole, _SHARED).unionByName(back)


def _prefixes(sets: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket of sets: the shared part of each prefix, with each entry's place in the set's order (or a lower one)."""
    empty = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("h", "rid", "n", "place")})
    if not len(entries) or not len(sets):
        return empty
    h = np.concatenate([np.frombuffer(x, np.uint64) for x in entries["hashes"]])
    rid = np.concatenate([np.frombuffer(x, np.int64) for x in entries["rids"]])
    held = np.concatenate([np.frombuffer(x, np.int64) for x in entries["held"]])
    sets = sets.sort_values("rid")
    names = sets["rid"].to_numpy()
    known = names[np.minimum(np.searchsorted(names, rid), len(names) - 1)] == rid  # sets of rows without an id are not
    h, rid, held = h[known], rid[known], held[known]
    if not len(h):
        return empty
    back = h >= _FRONT_END
    order = np.lexsort((h, np.where(back, 0, held), back, rid))
    h, rid, back = h[order], rid[order], back[order]
    of = np.searchsorted(names, rid)
    n, front = sets["n"].to_numpy()[of], sets["front"].to_numpy()[of]
    p = n - (PERCENT * n + 99) // 100 + 1
    first = np.r_[True, rid[1:] != rid[:-1]]
    begin = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    shared_front = np.add.reduceat((~back).astype(np.int64), begin)[group]
    place = np.arange(len(h)) - begin[group]
    # entries that no other set holds come before these
    at = front - shared_front + place
    keep = back | (at < p)
    return pd.DataFrame({"h": h[keep].view(np.int64), "rid": rid[keep], "n": n[keep], "place": at[keep]})


def _meetings(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one fragment of prefix entries: pairs of sets that can be linked (hot False), and chains through large buckets (hot True).

    A linked pair passes the test at its first common entry: what follows there in the shorter rest suffices for the overlap.
    """
    h, rid, n, place = (pdf[c].to_numpy() for c in ("h", "rid", "n", "place"))
    order = np.lexsort((rid, n, h))
    h, rid, n, rest = h[order], rid[order], n[order], (n - place)[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    size = np.diff(np.r_[first, len(h)])
    pairs = []
    for m in np.unique(size[(size > 1) & (size <= LARGE)]).tolist():
        i, j = np.triu_indices(m, 1)
        begins = first[size == m]
        for part in np.array_split(begins, -(-len(begins) * len(i) // 1_000_000)):
            x, y = (part[:, None] + i[None, :]).ravel(), (part[:, None] + j[None, :]).ravel()
            ok = (100 * n[x] >= PERCENT * n[y]) & ((100 + PERCENT) * np.minimum(rest[x], rest[y]) >= PERCENT * (n[x] + n[y]))
            pairs.append(np.stack([x[ok], y[ok]]))
    chains = [np.zeros((2, 0), np.int64)]
    for a, m in zip(first[size > LARGE].tolist(), size[size > LARGE].tolist(), strict=True):
        x = np.arange(a, a + m - 1)
        x = x[100 * n[x] >= PERCENT * n[x + 1]]  # in order of size: sets of linkable sizes are joined through those between
        chains.append(np.stack([x, x + 1]))
    x, y = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    low = rid[x] < rid[y]
    met = pd.DataFrame({"u": np.where(low, rid[x], rid[y]), "nu": np.where(low, n[x], n[y]), "v": np.where(low, rid[y], rid[x]), "nv": np.where(low, n[y], n[x]), "hot": False}).drop_duplicates()
    # the chains of all large buckets here come to one link a set, to the least set that it hangs together with
    x, y = np.concatenate(chains, axis=1)
    rids, node = np.unique(np.r_[rid[x], rid[y]], return_inverse=True)
    root = _joined(len(rids), node[: len(x)], node[len(x) :])
    hung = np.flatnonzero(root != np.arange(len(rids)))
    return pd.concat([met, pd.DataFrame({"u": rids[root[hung]], "nu": 0, "v": rids[hung], "nv": 0, "hot": True})])


def meetings(prefixes: DataFrame, n: int, most: int) -> DataFrame:
    """Pairs and chains of all buckets. The sets of a bucket of more than ``most`` are chained by windows instead of in one task:
    equal sizes by part, the parts of a size, and the sizes in order."""
    schema = "u long, nu long, v long, nv long, hot boolean"
    huge = written(prefixes.groupBy("h").agg(F.count("*").alias("held")).where(F.col("held") > most), "huge")
    n_huge = huge.count()
    if not n_huge:
        return prefixes.groupBy(F.pmod("h", F.lit(n)).alias("f")).applyInPandas(_meetings, schema).distinct()
    chosen = F.broadcast(huge) if n_huge <= MOST_SENT else huge
    usual = prefixes.join(chosen, "h", "left_anti").groupBy(F.pmod("h", F.lit(n)).alias("f")).applyInPandas(_meetings, schema)
    part = F.pmod(F.xxhash64("rid"), F.ceil(F.col("held") / most)).alias("part")
    least = F.min("rid").over(Window.partitionBy("h", "n", "part")).alias("least")
    sets = prefixes.join(chosen, "h").select("h", "n", "rid", part).select("h", "n", "part", "rid", least)
    parts = sets.groupBy("h", "n", "part").agg(F.min("rid").alias("rid")).select("h", "n", "rid", F.min("rid").over(Window.partitionBy("h", "n")).alias("least"))
    by_size = Window.partitionBy("h").orderBy("n")
    sizes = parts.groupBy("h", "n").agg(F.min("rid").alias("rid")).select("n", "rid", F.lag("rid").over(by_size).alias("least"), F.lag("n").over(by_size).alias("before"))
    chains = sets.select("rid", "least").unionByName(parts.select("rid", "least")).unionByName(sizes.where(100 * F.col("before") >= PERCENT * F.col("n")).select("rid", "least"))
    zero = F.lit(0).cast("long")
    linked_to = chains.where(F.col("rid") != F.col("least")).select(F.col("least").alias("u"), zero.alias("nu"), F.col("rid").alias("v"), zero.alias("nv"), F.lit(True).alias("hot"))
    return usual.unionByName(linked_to).distinct()


def _partial(sets: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """Of one fragment of a bucket of pairs: how many of its shingles the two sets of each pair share."""
    empty = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("u", "v", "nu", "nv", "shared")})
    if not len(sets) or not len(pairs):
        return empty
    sets = sets.drop_duplicates("rid").sort_values("rid")
    rids = sets["rid"].to_numpy()
    held = [np.frombuffer(x, np.uint64) for x in sets["found"]]
    size = np.fromiter(map(len, held), np.int64, len(held))
    begin = np.cumsum(size) - size
    known, code = np.unique(np.concatenate(held), return_inverse=True)
    code = code.astype(np.int64)
    pairs = pairs[np.isin(pairs["u"], rids) & np.isin(pairs["v"], rids)]
    u, v = np.searchsorted(rids, pairs["u"].to_numpy()), np.searchsorted(rids, pairs["v"].to_numpy())
    shared = np.zeros(len(pairs), np.int64)
    ends = np.cumsum(size[u] + size[v])
    for part in np.split(np.arange(len(u)), np.searchsorted(ends, np.arange(2_000_000, int(ends[-1]) if len(ends) else 0, 2_000_000))):
        if len(part):
            keys = [code[spread(begin[w[part]], size[w[part]])] + np.repeat(np.arange(len(part)), size[w[part]]) * len(known) for w in (u, v)]
            at = np.searchsorted(keys[0], keys[1])
            same = (at < len(keys[0])) & (keys[0][np.minimum(at, len(keys[0]) - 1)] == keys[1]) if len(keys[0]) else np.zeros(len(keys[1]), bool)
            shared[part] = np.bincount(keys[1][same] // len(known), minlength=len(part))
    out = pairs[["u", "v", "nu", "nv"]].copy()
    out["shared"] = shared
    return out[out["shared"] > 0]


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component: labels fall along links and through each other until none falls."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all linked pairs within ``left`` or, if given, between ``left`` and ``right``."""
    sets = left + (right or [])
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    h, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(h, kind="stable")
    h, of = h[order], of[order]
    first = np.r_[True, h[1:] != h[:-1]]
    column = np.cumsum(first) - 1
    several = np.bincount(column)[column] > 1
    of, column = of[several], np.cumsum(first & several)[several] - 1
    n_columns = int(column[-1]) + 1 if len(column) else 0
    k = len(left)
    overlap = np.zeros((k, len(right) if right else k), np.float32)
    for low in range(0, n_columns, _COLUMNS):  # partial overlaps of one fragment, summed per pair
        a, b = np.searchsorted(column, [low, low + _COLUMNS])
        there = np.zeros((len(sets), min(_COLUMNS, n_columns - low)), np.float32)
        there[of[a:b], column[a:b] - low] = 1
        overlap += there[:k] @ (there[k:] if right else there).T
    both = overlap.astype(np.int64)
    i, j = np.nonzero(100 * both >= PERCENT * (sizes[:k, None] + sizes[None, k if right else 0 : None if right else k] - both))
    return (i, j + k) if right else (i[i < j], j[i < j])


def _cells(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a few cells: their links, as spanning forests."""
    out = []
    for _, cell in pdf.drop_duplicates(["group", "one", "two", "rid"]).groupby(["group", "one", "two"], sort=False):
        rids = cell["rid"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in cell["found"]]
        one, two = cell["one"].iloc[0], cell["two"].iloc[0]
        if one == two:
            order, i, j = rids, *linked(sets)
        else:
            left = np.flatnonzero(cell["block"].to_numpy() == one)
            right = np.flatnonzero(cell["block"].to_numpy() == two)
            if not len(left) or not len(right):
                continue
            order, i, j = rids[np.r_[left, right]], *linked([sets[x] for x in left], [sets[x] for x in right])
        root = _joined(len(order), i, j)
        moved = root != np.arange(len(order))
        out.append(pd.DataFrame({"u": order[moved], "v": order[root[moved]]}))
    return pd.concat(out) if out else pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})


def _sets_of(docs: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """``wanted`` (doc_id, rid, ...) with each record's sorted hashes."""
    kept = [c for c in wanted.columns if c != "doc_id"]
    schema = wanted.select(*kept).schema.add("found", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = dict(zip(batch.schema.names, batch.columns, strict=True))
            found = list(shingle_sets([t or "" for t in held["text"].to_pylist()]))
            # an id that several rows share may bring another text
            same = pa.array([len(x) > 0 and record_id(x) == r for x, r in zip(found, held["rid"].to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(held[c] for c in kept), pa.array([x.tobytes() for x in found], pa.binary())], names=schema.names).filter(same)

    # up to MOST_SENT rows of five numbers are sent to every executor; more are joined by a shuffle
    chosen = F.broadcast(wanted) if n_wanted <= MOST_SENT else wanted
    return docs.select(F.col("doc_id").cast("long"), "text").join(chosen, "doc_id").mapInArrow(run, schema)


def _dealt(pairs: DataFrame, a_bucket: int) -> DataFrame:
    """``pairs`` with the bucket that compares each. A bucket's size does not grow with the table: a set meets a bounded number of others."""
    load = pairs.agg(F.coalesce(F.sum(F.col("nu") + F.col("nv")), F.lit(0))).first()[0]
    ends = pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    return pairs.join(least, "u").withColumn("bucket", F.pmod(F.xxhash64("least"), F.lit(max(1, -(-load // a_bucket)))).cast("int")).drop("least")


def _cut(sets: DataFrame) -> DataFrame:
    """(bucket, cut, rid, found): each set's hashes by fragment, for every bucket that it has a pair in."""
    bounds = np.array([(k << 64) // CUTS for k in range(1, CUTS)], np.uint64)
    names = ["bucket", "cut", "rid", "found"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for pdf in batches:
            for rid, buckets, found in zip(pdf["rid"], pdf["buckets"], pdf["found"], strict=True):
                h = np.frombuffer(found, np.uint64)
                ends = np.searchsorted(h, bounds)
                held = [(k, h[a:b].tobytes()) for k, (a, b) in enumerate(zip([0, *ends], [*ends, len(h)], strict=True)) if b > a]
                for bucket in buckets:
                    rows += [(bucket, k, rid, x) for k, x in held]
                    size += len(h) + 100
                    if size > 1_000_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
        yield pd.DataFrame(rows, columns=names)

    return sets.select("rid", "buckets", "found").mapInPandas(run, "bucket int, cut int, rid long, found binary")


def inside(grouped: DataFrame, n_tasks: int, block: int) -> DataFrame:
    """Links within groups. Every block is compared with itself and with its group's pivots, about one set in ``PIVOTS`` of a block;
    what hangs together by these links needs no other comparison within. Sets of different components then meet, block by block."""
    task = F.pmod(F.xxhash64("group", "one", "two"), F.lit(n_tasks)).alias("task")

    def compared(cells: DataFrame) -> DataFrame:
        return cells.select("rid", "group", "block", "one", "two", "found").groupBy(task).applyInPandas(_cells, "u long, v long")

    at = F.xxhash64("rid")
    own = grouped.withColumn("block", F.pmod(at, F.col("blocks")).cast("int"))
    pivots = grouped.where((F.col("blocks") > 1) & (F.pmod(at, F.col("blocks") * PIVOTS) == 0)).withColumn("block", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)))
    links = written(compared(own.unionByName(pivots).withColumns({"one": F.col("block"), "two": F.col("block")})), "near")
    several = grouped.where(F.col("blocks") > 1)
    if not several.head(1):
        return links

    roots = components(links).withColumnRenamed("node", "rid")
    sets = several.select("rid", "group").join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    # a component of a block or more has blocks of its own, that are not compared with each other; smaller ones share blocks
    counts = sets.groupBy("group", "root").agg(F.count("*").alias("size")).withColumn("kind", F.when(F.col("size") >= block, F.col("root")))
    kinds = counts.groupBy("group", "kind").agg(F.ceil(F.sum("size") / block).cast("int").alias("k"))
    before = Window.partitionBy("group").orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumns({"start": F.coalesce(F.sum("k").over(before), F.lit(0)).cast("int"), "blocks": F.sum("k").over(Window.partitionBy("group")).cast("int"), "mixed": F.col("kind").isNull()})
    kinds = kinds.where(F.col("mixed") | (F.col("blocks") > F.col("k"))).withColumnsRenamed({"group": "of", "kind": "of_kind"})
    placed = counts.join(kinds, (F.col("group") == F.col("of")) & F.col("kind").eqNullSafe(F.col("of_kind"))).select("group", "root", "k", "start", "blocks", "mixed")
    dealt = sets.join(placed, ["group", "root"]).select("rid", "group", "k", "start", "blocks", "mixed")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.col("mixed") | (x < F.col("start")) | (x >= F.col("start") + F.col("k")))
    met = several.select("rid", "group", "found").join(dealt, ["rid", "group"]).withColumn("block", (F.col("start") + F.pmod(at, F.col("k"))).cast("int"))
    met = met.withColumn("other", F.explode(others)).withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    return links.unionByName(compared(met))


def join(docs: DataFrame, docs_a_fragment: int = 4096, block: int = BLOCK, paired: int = PAIRED, a_task: int = ENTRIES, a_bucket: int = HUGE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    n = max(1, -(-docs.select("doc_id").count() // docs_a_fragment))
    seen = written(scan(docs, n), "shingles")
    each = seen.where(F.col("n").isNotNull()).select("doc_id", "n", "front", "rid")
    classes = written(each.where(F.col("rid").isNotNull() & F.col("doc_id").isNotNull()).groupBy("rid").agg(F.min("n").alias("n"), F.min("front").alias("front"), F.min("doc_id").alias("least")), "classes")

    shared = shared_entries(seen.where(F.col("fragment").isNotNull()).select("fragment", "hashes", "owners", "names"), n, a_task)
    sets = classes.select("rid", "n", "front", F.pmod("rid", F.lit(n)).cast("int").alias("bucket"))
    prefixes = sets.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInPandas(_prefixes, "h long, rid long, n long, place long")
    met = written(meetings(written(prefixes, "prefixes"), n, max(a_bucket, LARGE)), "pairs")
    pairs, chains = met.where(~F.col("hot")).drop("hot"), met.where("hot").select("u", "v")

    groups = components(chains) if chains.head(1) else chains.select(F.col("u").alias("node"), F.col("v").alias("root"))
    groups = groups.select(F.col("node").alias("rid"), F.col("root").alias("group"))
    sizes = groups.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    pairs = written(_dealt(pairs, paired), "dealt")
    of_pairs = pairs.select(F.explode(F.array("u", "v")).alias("rid"), "bucket").groupBy("rid").agg(F.collect_set("bucket").alias("buckets"))
    wanted = of_pairs.join(groups.join(sizes, "group"), "rid", "full").join(classes.select("rid", F.col("least").alias("doc_id")), "rid")
    wanted = written(wanted.select("doc_id", "rid", "group", "blocks", "buckets"), "wanted")
    n_wanted = wanted.agg(F.count("*") + F.coalesce(F.sum(F.when(F.col("buckets").isNotNull(), F.size("buckets"))), F.lit(0))).first()[0]
    found = written(_sets_of(docs, wanted, n_wanted), "sets")

    # pairs: partial overlaps by fragment, summed
    each_cut = pairs.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(CUTS - 1))))
    partial = _cut(found.where(F.col("buckets").isNotNull())).groupBy("bucket", "cut").cogroup(each_cut.groupBy("bucket", "cut")).applyInPandas(_partial, "u long, v long, nu long, nv long, shared long")
    summed = partial.groupBy("u", "v", "nu", "nv").agg(F.sum("shared").alias("o"))
    links = summed.where(100 * F.col("o") >= PERCENT * (F.col("nu") + F.col("nv") - F.col("o"))).select("u", "v")
    groups_links = inside(found.where(F.col("group").isNotNull()).select("rid", "group", "blocks", "found"), 4 * n, block)
    roots = components(links.unionByName(groups_links)).select(F.col("node").alias("rid"), "root")

    linked_to = classes.join(roots, "rid").groupBy("root").agg(F.min("least").alias("component_id")).join(roots, "root").select("rid", "component_id")
    named = classes.join(linked_to, "rid", "left").select("rid", F.coalesce("component_id", "least").alias("component_id"))
    alone = F.coalesce("component_id", "doc_id")
    return each.join(named, "rid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), alone).alias("component_id"))
