"""Language ID (1): cross-parsing entropy over suffix automata.

For each language a suffix automaton of labelled text accepts exactly the strings that occur in it. A text is parsed
greedily against each: a phrase is the longest match from where the last one ended. Fewer phrases mean a closer language;
phrases are normalised as ``phrases * log2(length of the language's text) / symbols``, the cross-parsing estimate of bits a
symbol, and the language needing fewest wins.

The training text is bounded: per language at most ``most_docs`` whole labelled documents outside the held-out fold (short
ones first, of smallest id hash) and ``most_symbols`` characters in all. Texts being judged are read whole. Symbols: letters,
lower-cased; anything else is one gap symbol, runs of gaps one gap. Automata are tables, so many texts are parsed at once,
one symbol of each a step; a long text is parsed in segments whose parses are carried on into each other, so phrases cross them.

``und``, score 0: null texts and texts without a letter, and all texts if nothing was labelled. Ties go to the language
that comes first in the alphabet. An empty table gives no rows; repeated rows get equal results and teach once; rows without
language or with a null id teach nothing. ``lang_pred`` and ``score`` take the places of kept columns of these names; columns
other than the kept ones and the text are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import is_held_out, map_rows, one_model, small_batches
from siftwell.llm.wordhash import LETTER, WordTable, char_classes, code_points

#: Symbols that are parsed at once as if a phrase began there, and cells up to which automata are full tables (96 MB).
SEGMENT, MOST_CELLS = 2048, 24_000_000
#: How sharply differences of bits a symbol become a score.
SHARPNESS = 12.0


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts, lower-cased, with one 0 for each gap between them; and where each text begins."""
    cp, ends = code_points([t.lower() for t in texts])
    symbols = np.where(char_classes()[cp] == LETTER, cp, np.uint32(0))
    keep = symbols != 0
    keep[1:] |= symbols[:-1] != 0
    first = ends[:-1][np.diff(ends) > 0]
    keep[first] = symbols[first] != 0  # whatever text stands before
    return symbols[keep], np.r_[0, np.cumsum(keep)][ends]


class SuffixAutomaton:
    """All substrings of a sequence of small integers; state 0 is the root."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new



class DenseTable:
    """Steps of an automaton as one cell for each state and symbol: the next state's row, and whether a new phrase begins."""

    def __init__(self, automaton: SuffixAutomaton, n_symbols: int):
        t = np.zeros((len(automaton.next), n_symbols), np.int32)
        root = np.ones(n_symbols, np.int32)  # a symbol that the text lacks is a phrase of its own and leads to the root
        for c, to in automaton.next[0].items():
            root[c] = to * n_symbols << 1 | 1
        t[:] = root
        for s, arcs in enumerate(automaton.next):
            if arcs and s:
                t[s, list(arcs)] = [to * n_symbols << 1 for to in arcs.values()]
        self.cells = t.ravel()

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = self.cells[state + c]
        return v >> 1, (v & 1).astype(bool)


class SparseTable:
    """The same steps, with a hash table of the arcs that there are: for large alphabets."""

    def __init__(self, automaton: SuffixAutomaton, n_symbols: int):
        self.n, self.arcs = np.uint64(n_symbols), WordTable(most=1 << 62)
        keys = np.fromiter((s * n_symbols + c + 1 for s, arcs in enumerate(automaton.next) if s for c in arcs), np.uint64)
        self.arcs.add(keys, np.fromiter((to for s, arcs in enumerate(automaton.next) if s for to in arcs.values()), np.int32))
        self.root = np.zeros(n_symbols, np.int32)
        for c, to in automaton.next[0].items():
            self.root[c] = to

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = self.arcs.find(state.astype(np.uint64) * self.n + c + np.uint64(1))
        new = to < 0
        return np.where(new, self.root[c], to), new


class Model:
    """The languages, their tables, and the symbols known to any of them."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        parts = {k: [folded([t])[0] for t in texts[k]] for k in self.langs}
        known = np.unique(np.concatenate([np.zeros(1, np.uint32), *(p for v in parts.values() for p in v)]))
        self.n = len(known) + 1
        self.code = np.full(0x110000, self.n - 1, np.uint32 if len(known) > 65_000 else np.uint16)  # the last: a symbol that no language has
        self.code[known] = np.arange(len(known))
        joined = {k: np.concatenate([np.r_[self.code[p], self.code[0]] for p in parts[k]]) if parts[k] else np.zeros(1, np.uint16) for k in self.langs}
        dense = 2 * sum(map(len, joined.values())) * self.n <= MOST_CELLS  # a text of n symbols has at most 2 n states
        self.tables = [(DenseTable if dense else SparseTable)(SuffixAutomaton(joined[k].tolist()), self.n) for k in self.langs]
        self.bits = [np.log2(max(2, len(joined[k]))) for k in self.langs]

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a symbol of each text in each language, and how many letters each has."""
        symbols, at = folded(texts)
        size = np.diff(at)
        letters = np.diff(np.r_[0, np.cumsum(symbols != 0)][at])
        codes = self.code[symbols]
        cut = Cut(at)
        out = np.zeros((len(texts), len(self.langs)))
        for k, (table, bits) in enumerate(zip(self.tables, self.bits, strict=True)):
            phrases = np.r_[0, np.cumsum(phrase_starts(table, codes, cut))]
            out[:, k] = np.diff(phrases[at]) * bits
        return out / np.maximum(1, size)[:, None], letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        langs, scores = [], np.zeros(len(texts))
        for a, b in small_batches(texts):
            cost, letters = self.costs(texts[a:b])
            if not self.langs:
                langs += ["und"] * (b - a)
                continue
            best = cost.argmin(axis=1)
            share = 1 / np.exp(-SHARPNESS * (cost - cost.min(axis=1, keepdims=True))).sum(axis=1)
            scores[a:b] = np.where(letters > 0, share, 0.0)
            langs += [self.langs[k] if n else "und" for k, n in zip(best.tolist(), letters.tolist(), strict=True)]
        return langs, scores


class Cut:
    """Texts (``at``: where each begins) as segments of at most ``SEGMENT`` symbols, longest first."""

    def __init__(self, at: np.ndarray):
        size = np.diff(at)
        n_seg = -(-size // SEGMENT)
        place = np.arange(n_seg.sum()) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
        start = np.repeat(at[:-1], n_seg) + place * SEGMENT
        length = np.minimum(SEGMENT, np.repeat(size, n_seg) - place * SEGMENT)
        order = np.argsort(-length, kind="stable")
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        self.start, self.length = start[order], length[order]
        # the segment that follows each in its text, or -1
        follows = np.r_[place[1:] > 0, False][: len(place)]
        after = np.where(follows, np.r_[where[1:], -1][: len(where)], -1) if len(where) else where
        self.after = after[order]
        steps = int(self.length[0]) if len(self.length) else 0
        self.live = np.searchsorted(-self.length, -np.arange(steps), "left")  # how many segments have a symbol at each step


def phrase_starts(table: DenseTable | SparseTable, codes: np.ndarray, cut: Cut) -> np.ndarray:
    """For each symbol whether a phrase of its text's greedy parse begins there.

    All segments are parsed at once, each as if a phrase began with it. Then the parse of each segment is carried on into
    the next one until both begin a phrase at the same symbol: from there on they are the same.
    """
    starts = np.zeros(len(codes), bool)
    state = np.zeros(len(cut.start), np.int32)
    for i, n in enumerate(cut.live.tolist()):
        at = cut.start[:n] + i
        state[:n], starts[at] = table.step(state[:n], codes[at])
    lane = np.flatnonzero(cut.after >= 0)
    while len(lane):
        segment, at_state = cut.after[lane], state[lane]
        changed = []
        for i in range(SEGMENT):
            inside = i < cut.length[segment]
            if not inside.all():  # the segment ended without a common phrase: its own end is another now
                ended = segment[~inside]
                state[ended] = at_state[~inside]
                changed.append(ended)
                segment, at_state = segment[inside], at_state[inside]
            if not len(segment):
                break
            at = cut.start[segment] + i
            at_state, new = table.step(at_state, codes[at])
            on = ~(new & starts[at])
            starts[at] = new
            segment, at_state = segment[on], at_state[on]
        else:
            state[segment] = at_state
            changed.append(segment)
        lane = np.concatenate(changed) if changed else lane[:0]
        lane = lane[cut.after[lane] >= 0]
    return starts


def training_text(docs: DataFrame, most_docs: int = 48, most_symbols: int = 36_000, longest: int = 4_000) -> dict[str, list[str]]:
    """Per language whole texts of at most ``most_docs`` labelled documents, ``most_symbols`` characters in all (one text at least).

    Texts of at most ``longest`` characters come first, in order of id hash; of rows with one id and language one teaches.
    """
    size = F.length("text")
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out())
    # ids are ranked without their texts; the few chosen ones then fetch theirs
    order = [size > longest, F.xxhash64("doc_id"), "doc_id"]
    ids = rows.select("doc_id", "lang", "text").withColumn("late", order[0]).withColumn("size", size).drop("text")
    by = ["late", F.xxhash64("doc_id"), "doc_id"]
    first = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64))).orderBy(*by))
    few = ids.withColumn("r", first).where(F.col("r") <= most_docs).groupBy("lang", "doc_id").agg(F.min("late").alias("late"), F.min("size").alias("size"))
    rank = Window.partitionBy("lang").orderBy(*by)
    few = few.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= most_docs).withColumn("sum", F.sum("size").over(rank))
    chosen = few.where((F.col("sum") <= most_symbols) | (F.col("r") == 1)).select("lang", "doc_id", "size")
    got = rows.withColumn("size", size).join(F.broadcast(chosen), ["lang", "doc_id", "size"]).groupBy("lang", "doc_id").agg(F.min("text").alias("t")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["doc_id"])):
        out.setdefault(r["lang"], []).append(r["t"])
    return out


def predict(docs: DataFrame, texts: dict[str, list[str]], keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: doc_id) with ``lang_pred`` and ``score``, from the text alone."""
    packed = pickle.dumps(texts)

    def make():
        model = one_model(("languages", packed), lambda: Model(pickle.loads(packed)))
        return lambda held: model.predict([t or "" for t in held])

    return map_rows(docs, ["doc_id"] if keep is None else keep, ["text"], "lang_pred string, score double", make)
