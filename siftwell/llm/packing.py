"""Best-fit packing (2): documents into sequences of at most ``capacity`` tokens, improved locally by swaps.

Texts become ids once, in the scan; from then on only (id, piece, length, checksum) rows move. Pieces are dealt by a hash
of their place to blocks of about ``block_docs`` documents. A block starts from best fit in falling length; then the emptiest underfull
bin gives what it holds to others: moves, one-for-one, two-for-one and one-for-two exchanges, always the one that fills
the other bin most, so the sum of squared fills grows with each step, until the bin is empty or no step is left. A block is
done when it has the least possible number of bins or no underfull bin has a step left.
A block's last bins are not shared with other blocks: at most about one sequence a block is lost to that.

Null texts count as empty: one piece that holds just the end id. Longer documents than a sequence are cut so that only
the first piece is shorter. Repeated rows are packed as often as they come; an empty table gives no rows; other columns
are not read. Pieces are dealt and equal lengths placed by a hash of where they stand in the input, so that repeated or null
ids are spread like any others; ids are passed on as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.bpe import Encoder, ids_crc32
from siftwell.llm.common import one_model
from siftwell.llm.wordhash import mixed
from siftwell.session import ship

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
COLUMNS = f"{_PIECES}, sequence_id long, offset long"



def tokenizer(json_path: str) -> WithAdded:
    """The encoder of a file, one a worker process."""
    return one_model(("json", json_path), lambda: _tokenizer(json_path))


def _tokenizer(json_path: str) -> WithAdded:
    """The ids that the public ``tokenizers`` file gives.

    The file's own vocabulary and merge ranks are read; a new piece goes through the merge loop of ``tiktoken``, which
    gives the same ids for the same ranks, and known pieces come from the table. The file's added tokens are cut out first.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(json_path, encoding="utf-8") as f:
        file = json.load(f)
    vocab, added = file["model"]["vocab"], {x["content"]: x["id"] for x in file["added_tokens"]}
    if any(x[flag] for x in file["added_tokens"] for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that depend on what stands around them are not supported")
    byte_of = {c: b for b, c in _byte_letters().items()}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if all(c in byte_of for c in t) and t not in added}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return WithAdded(Encoder(ranks, plain._encode_single_piece), added)


class WithAdded:
    """An encoder that gives added tokens their ids wherever their contents stand, the longest first, and encodes what lies between."""

    def __init__(self, plain: Encoder, added: dict[str, int]):
        self.plain, self.added = plain, added
        self.pattern = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        cut = [self.pattern.split(t) if any(x in t for x in self.added) else [t] for t in texts]
        between = self.plain.encode([part for parts in cut for part in parts[::2]])
        for parts in cut:
            ids = [next(between)]
            for token in parts[1::2]:
                ids += [np.array([self.added[token]], np.uint32), next(between)]
            yield np.concatenate(ids) if len(ids) > 1 else ids[0]


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}




def pieces(docs: DataFrame, json_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, deal): the ids of each document with its end id, cut where longer than ``capacity``.

    ``deal`` is a hash of the piece's place in its input, by which pieces are spread evenly whatever their ids are.
    """
    ship(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "deal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = tokenizer(json_path), np.array([end_id], np.uint32)
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            owner, rows = [], []
            for doc, ids in enumerate(enc.encode([t or "" for t in batch.column(1).to_pylist()])):
                ids = np.concatenate([ids, end])
                start, length = 0, (len(ids) - 1) % capacity + 1
                for piece in range(-(-len(ids) // capacity)):
                    owner.append(doc)
                    rows.append((piece, start, length, ids_crc32(ids[start : start + length])))
                    start, length = start + length, capacity
            found = np.array(rows, np.int64).reshape(-1, 4)
            deal = mixed((np.arange(n, n + len(rows), dtype=np.uint64) << np.uint64(24)) + np.uint64(part)).view(np.int64)
            n += len(rows)
            # ids stay Arrow values: as floats beside nulls they would be rounded
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(found[:, 0].astype(np.int32)), *(pa.array(found[:, k]) for k in (1, 2, 3)), pa.array(deal)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"{_PIECES}, deal long")


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """The bins, as lists of places in ``sizes``; every size is from 1 to ``capacity``."""
    bins: list[list[int]] = []
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r: some bin has r tokens of room
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fitting = free >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                free &= ~(1 << r)
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
            room.append(0)
        room[b] = r = r - size
        if r:
            by_room[r].append(b)
            free |= 1 << r
    least = -(-sum(sizes) // capacity)
    if len(bins) > least:
        _improve(bins, room, sizes, capacity, least)
    return [b for b in bins if b]


def _subsets(held: list[int], sizes: list[int], empty: bool):
    """(total, places) of at most two pieces of a bin, one for each different total of as many pieces."""
    found: dict[tuple[int, int], tuple[int, ...]] = {(0, 0): ()} if empty else {}
    some, of_size = [], {}
    for i in held:  # equal pieces are worth the same
        of_size[sizes[i]] = of_size.get(sizes[i], 0) + 1
        if of_size[sizes[i]] <= 2:
            some.append(i)
    for k, i in enumerate(some):
        found.setdefault((sizes[i], 1), (i,))
        for j in some[:k]:
            found.setdefault((sizes[i] + sizes[j], 2), (i, j))
    return [(t, w) for (t, _), w in found.items()]


def _improve(bins: list[list[int]], room: list[int], sizes: list[int], capacity: int, least: int) -> None:
    """Empties bins, emptiest first, by the exchange that raises the squared fill most, until no underfull bin has one left."""
    gone = 2 * capacity + 1
    total, owner, taken, what = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
    rooms, seen = np.array(room, np.int64), np.zeros(len(bins), np.int64)  # seen: so many entries were tried since the bin changed
    count = len(bins)

    def enter(some: list[int]) -> None:
        nonlocal total, owner, taken, what, seen
        for b in some:
            total[owner == b] = gone  # no longer there
        if len(total) > 10_000 and 4 * int((total < gone).sum()) < len(total):
            there = total < gone
            seen = np.r_[0, np.cumsum(there)][seen]
            what = [what[k] for k in np.flatnonzero(there).tolist()]
            total, owner, taken = total[there], owner[there], taken[there]
        new = [(t, b, len(w), w) for b in some if bins[b] for t, w in _subsets(bins[b], sizes, True)]
        total, owner, taken = (np.r_[x, np.array([n[c] for n in new], np.int64)] for c, x in enumerate((total, owner, taken)))
        what += [n[3] for n in new]

    def exchange(e: int) -> tuple[int, int, tuple[int, ...]]:
        """(gain, entry, what the bin gives), of entries that it has not tried yet; the gain is 0 if there is none."""
        first, best = int(seen[e]), (0, -1, ())
        t, o = total[first:], owner[first:]
        key = t + rooms[o]  # the most that may be given for what is got
        fits = (t < gone) & (o != e)
        for n in (1, 2):
            gives = [(a, w) for a, w in _subsets(bins[e], sizes, False) if len(w) == n]
            at = np.flatnonzero(fits & (taken[first:] < 2) if n == 2 else fits)
            if not gives or not len(at):
                continue
            low = np.full(capacity + 1, gone)
            np.minimum.at(low, key[at], t[at])
            # the other bin must get fuller than this one was, else squares would not grow
            a = np.array([x for x, _ in gives])
            reach = np.lib.stride_tricks.sliding_window_view(low, room[e])[a].min(axis=1)
            k = int(np.argmax(a - reach))
            if a[k] - reach[k] > best[0]:
                hit = at[(t[at] == reach[k]) & (key[at] >= a[k]) & (key[at] < a[k] + room[e])]
                best = (int(a[k] - reach[k]), first + int(hit[0]), gives[k][1])
        return best

    enter([b for b in range(len(bins)) if room[b]])
    while count > least:
        waiting = np.flatnonzero((rooms > 0) & (rooms < capacity) & (seen < len(total)))
        if not len(waiting):
            break
        e = int(waiting[len(waiting) - 1 - np.argmax(rooms[waiting][::-1])])
        while bins[e]:
            gain, k, gives = exchange(e)
            if not gain:
                seen[e] = len(total)
                break
            b, gets = int(owner[k]), what[k]
            bins[e] = [i for i in bins[e] if i not in gives] + list(gets)
            bins[b] = [i for i in bins[b] if i not in gets] + list(gives)
            room[e], room[b] = room[e] + gain, room[b] - gain
            rooms[e], rooms[b] = room[e], room[b]
            seen[e] = seen[b] = 0
            enter([e, b])
        if not bins[e]:
            count -= 1


def pack_pieces(cut: DataFrame, n_docs: int, capacity: int = 2048, block_docs: int = 4096) -> DataFrame:
    """Each piece with its sequence and its place there."""
    ship(cut.sparkSession)
    blocks = max(1, -(-n_docs // block_docs))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("deal")
        sizes = table.column("length").to_pylist()
        block = table.column("block")[0].as_py()
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for k, held in enumerate(pack(sizes, capacity)):
            at = 0
            for i in held:
                sequence[i], offset[i] = (block << 32) + k, at
                at += sizes[i]
        return table.drop_columns(["block", "deal"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    block = F.pmod(F.col("deal"), F.lit(blocks)).alias("block")
    return cut.select("doc_id", "piece", "start", "length", "ids_crc32", "deal", block).groupBy("block").applyInArrow(run, COLUMNS)


def pack_documents(docs: DataFrame, json_path: str, capacity: int = 2048, end_id: int = 0, block_docs: int = 4096) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every document of (doc_id, text)."""
    return pack_pieces(pieces(docs, json_path, capacity, end_id), docs.select("doc_id").count(), capacity, block_docs)
