"""Byte-level BPE (5): merges compiled into a lazily determinised finite-state transducer, and a streaming decoder.

*Encoding.* A token list is the BPE encoding of its text exactly when each pair of neighbours in it is: so the last
token of every prefix follows from the last tokens of shorter prefixes. A state of the transducer holds the prefixes
from which a longer token may still begin, each with its last token and the tokens not yet written on the way there;
where all of them share their first tokens, those are written at once. Lookahead is bounded by the longest token.
States and arcs are made when first needed and kept; when ``most_states`` is reached they are dropped and made anew,
which changes speed and nothing else.

*Decoding.* Ids become bytes one token at a time; a UTF-8 state machine, lifted from bytes to tokens, says after each
token how many bytes end complete characters, so text leaves as soon as it can and never in half characters.

Null texts count as empty, empty texts have no ids, whole texts of any length are taken; repeated rows give equal
results; an empty table gives no rows. Merges of equal rank go from left to right, as the library has it. Ids are passed on
as they are, null or not; ``encode_decode`` reads no other column and ``token_ids`` replaces one that is named as its own.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from siftwell.llm.common import map_rows, one_model, small_batches
from siftwell.llm.wordhash import WordTable, code_points, pattern_pieces, span_hashes, spread


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Bytes in, token ids out, for one piece at a time.

    A state is a tuple of threads, one for each earlier place from which a token may still be under way: the bytes since
    that place, and what decides which tokens may end there: the last token before the place or, once at most ``FEW``
    tokens begin with those bytes, the set of those that may follow it. A thread whose set is empty has ended.
    """

    FEW = 4

    def __init__(self, ranks: dict[bytes, int], most_states: int = 300_000):
        self.ranks, self.most_states = ranks, most_states
        self.token = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.begun: dict[bytes, list[int]] = {}
        for t, r in ranks.items():
            for k in range(1, len(t)):
                self.begun.setdefault(t[:k], []).append(r)
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.arcs: list[dict[int, tuple[int, tuple[tuple[int, int], ...]]]] = []
        self.fits.clear()
        self.follow: dict[tuple[bytes, int], frozenset[int]] = {}
        self._state(((b"", -1, None),))

    def _state(self, key: tuple) -> int:
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.arcs.append({})
        return self.number[key]

    def split(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``t``, or None for a single byte: its bytes merged by rank until two remain."""
        if t not in self.parts:
            word = self.token[t]
            if len(word) == 1:
                self.parts[t] = None
            else:
                p = [word[i : i + 1] for i in range(len(word))]
                while len(p) > 2:
                    best = min(range(len(p) - 1), key=lambda i: (self.ranks.get(p[i] + p[i + 1], 1 << 60), i))
                    p[best : best + 2] = [p[best] + p[best + 1]]
                self.parts[t] = (self.ranks[p[0]], self.ranks[p[1]])
        return self.parts[t]

    def fit(self, a: int, b: int) -> bool:
        """Whether ``a`` then ``b`` stay two tokens: no merge across their border comes before those that make them."""
        found = self.fits.get((a, b))
        if found is None:
            x, y, limit, found = a, b, 1 << 60, True
            while True:
                r = self.ranks.get(self.token[x] + self.token[y])
                if r is not None and r < limit:
                    found = False
                    break
                left = x > y  # undo the later of the two merges, or the one that there is
                parts = self.split(x if left else y)
                if parts is None:
                    left = not left
                    parts = self.split(x if left else y)
                    if parts is None:
                        break
                if left:  # a merge on the left was made before one of its own rank across the border
                    limit, x = x, parts[1]
                else:
                    limit, y = y + 1, parts[0]
            self.fits[a, b] = found
        return found

    def _after(self, since: bytes, last: int, may: frozenset[int] | None) -> tuple | None:
        """The thread that goes on from here, if one does."""
        begun = self.begun.get(since)
        if begun is None:
            return None
        if may is None:
            if len(begun) > self.FEW or last < 0:
                return since, last, None
            may = self.follow.get((since, last))
            if may is None:
                may = self.follow[since, last] = frozenset(t for t in begun if self.fit(last, t))
        elif len(may) > 1:
            may = may.intersection(begun)
        elif not self.token[next(iter(may))].startswith(since) or self.ranks.get(since) in may:
            return None
        return (since, -2, may) if may else None

    def step(self, state: int, byte: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        """The next state, and for each of its threads the one it comes from and the token that ends with it (-1: none)."""
        threads, moves, tail = [], [], bytes((byte,))
        for k, (since, last, may) in enumerate(self.states[state]):
            since += tail
            t = self.ranks.get(since)
            if t is not None and (t in may if may is not None else last < 0 or self.fit(last, t)):
                threads.append((b"", t, None))
                moves.append((k, t))
            thread = self._after(since, last, may)
            if thread is not None:
                threads.append(thread)
                moves.append((k, -1))
        return self._state(tuple(threads)), tuple(moves)

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(self.states) > self.most_states:
            self._clear()
        state, out, arcs, path = 0, [], self.arcs, []
        bound = 4 * self.longest
        for byte in piece:
            arc = arcs[state].get(byte)
            if arc is None:
                arc = arcs[state][byte] = self.step(state, byte)
            state, moves = arc
            path.append(moves)
            if len(path) > bound:
                self._emit(path, out)
        self._walk(path, next(k for k, x in enumerate(self.states[state]) if not x[0]), out)
        return out

    @staticmethod
    def _walk(path: list, k: int, out: list[int]) -> None:
        """Appends the tokens on the way to thread ``k`` of the state after ``path``."""
        got = []
        for moves in reversed(path):
            k, t = moves[k]
            if t >= 0:
                got.append(t)
        out += reversed(got)

    def _emit(self, path: list, out: list[int]) -> None:
        """Writes what all threads share: from the last step back, to where they are one."""
        alive = set(range(len(path[-1])))
        for n in range(len(path) - 1, -1, -1):
            if len(alive) == 1:
                (k,) = alive
                self._walk(path[: n + 1], k, out)
                base = path[n + 1]
                # what is left begins anew: the threads of the next step all come from this one
                del path[: n + 1]
                path[0] = tuple((0, t) for _, t in base)
                return
            alive = {path[n][k][0] for k in alive}


#: UTF-8 as a machine: state -> ranges of the next byte and the state after it; 0 is between characters. Fixed values.
UTF8 = {
    0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 2), (0xE1, 0xEC, 3), (0xED, 0xED, 4), (0xEE, 0xEF, 3), (0xF0, 0xF0, 5), (0xF1, 0xF3, 6), (0xF4, 0xF4, 7)],
    1: [(0x80, 0xBF, 0)], 2: [(0xA0, 0xBF, 1)], 3: [(0x80, 0xBF, 1)], 4: [(0x80, 0x9F, 1)], 5: [(0x90, 0xBF, 3)], 6: [(0x80, 0xBF, 3)], 7: [(0x80, 0x8F, 3)],
}


class StreamDecoder:
    """Ids in, text out as soon as its characters are complete; ``finish`` raises if a character was left open."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.state, self.open = tokens, 0, b""
        self.arcs: dict[tuple[int, int], tuple[int, int]] = {}

    @staticmethod
    def run(state: int, data: bytes) -> tuple[int, int]:
        """The state after ``data`` and how many of its bytes end with the last complete character (-1: none)."""
        done = -1
        for i, b in enumerate(data):
            state = next((to for low, high, to in UTF8[state] if low <= b <= high), None)
            if state is None:
                raise UnicodeDecodeError("utf-8", data, i, i + 1, "invalid byte for this state")
            if state == 0:
                done = i + 1
        return state, done

    def feed(self, ids: Iterable[int]) -> Iterator[bytes]:
        """Bytes of whole characters only."""
        for t in ids:
            data = self.tokens[t]
            arc = self.arcs.get((self.state, t))
            if arc is None:
                arc = self.arcs[self.state, t] = self.run(self.state, data)
            self.state, done = arc
            if done < 0:
                self.open += data
            elif self.state == 0 and not self.open:
                yield data
            else:
                yield self.open + data[:done]
                self.open = data[done:]

    def finish(self) -> None:
        if self.open or self.state:
            raise UnicodeDecodeError("utf-8", self.open, 0, len(self.open), "the ids end inside a character")
        self.state = 0


class Encoder:
    """Whole texts to ids: pieces by the pattern, each new piece through the transducer, known pieces from a table."""

    def __init__(self, ranks: dict[bytes, int], piece_ids: Callable[[bytes], list[int]] | None = None):
        self.piece_ids = piece_ids or Transducer(ranks).encode
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.table = WordTable(most=2_000_000)
        self._forget()

    def _forget(self) -> None:
        self.first, self.count, self.ids, self.n_rows, self.n_ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32), 0, 0

    @functools.cached_property
    def written(self) -> list[bytes]:
        """Each id in decimal digits."""
        return [str(i).encode() for i in range(len(self.tokens))]

    @functools.cached_property
    def whole(self) -> np.ndarray:
        """Whether each token holds whole characters."""
        return np.fromiter((_is_whole(t) for t in self.tokens), bool, len(self.tokens))

    def _append(self, found: list[list[int]]) -> None:
        flat = np.fromiter((i for x in found for i in x), np.uint32)
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        while self.n_rows + len(found) > len(self.first):
            self.first, self.count = np.r_[self.first, np.zeros_like(self.first)], np.r_[self.count, np.zeros_like(self.count)]
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.first[self.n_rows : self.n_rows + len(found)] = self.n_ids + np.cumsum(sizes) - sizes
        self.count[self.n_rows : self.n_rows + len(found)] = sizes
        self.n_rows, self.n_ids = self.n_rows + len(found), self.n_ids + len(flat)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        for a, b in small_batches(texts):
            part = texts[a:b]
            joined = "".join(part)
            cp, ends = code_points(part)
            starts, lengths, at = pattern_pieces(cp, ends)

            def learn(places: np.ndarray, _base: int, joined=joined, starts=starts, lengths=lengths) -> None:
                encode = self.piece_ids
                self._append([encode(joined[s : s + k].encode("utf-8", "surrogatepass")) for s, k in zip(starts[places].tolist(), lengths[places].tolist(), strict=True)])

            rows = self.table.resolve(span_hashes(cp, starts, lengths), learn, self._forget)
            count = self.count[rows]
            ids = self.ids[spread(self.first[rows], count)]
            cuts = np.r_[0, np.cumsum(count)][at]
            for i in range(len(part)):
                yield ids[cuts[i] : cuts[i + 1]]


def encoder(path: str) -> Encoder:
    """One encoder a worker process; the path must be readable on every executor."""
    return one_model(("ranks", path), lambda: Encoder(load_ranks(path)))


def encode_decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every text: encoded, then its ids decoded as a stream."""

    def make():
        enc = encoder(ranks_path)
        written, whole, decoder = enc.written, enc.whole, StreamDecoder(enc.tokens)

        def run(texts: list[str | None]) -> tuple[list[int], list[str], list[str]]:
            counts, digests, decoded = [], [], []
            for ids in enc.encode([t or "" for t in texts]):
                as_list = ids.tolist()
                back = hashlib.sha256()
                # between tokens that hold whole characters the machine stays in state 0; it steps through the others
                odd = np.flatnonzero(~whole[ids])
                if len(odd):
                    lo, hi = int(odd[0]), int(odd[-1]) + 1
                    back.update(b"".join([enc.tokens[i] for i in as_list[:lo]]))
                    back.update(b"".join(decoder.feed(as_list[lo:hi])))
                    decoder.finish()
                    back.update(b"".join([enc.tokens[i] for i in as_list[hi:]]))
                else:
                    back.update(b"".join([enc.tokens[i] for i in as_list]))
                counts.append(len(as_list))
                digests.append(hashlib.sha256(b" ".join([written[i] for i in as_list])).hexdigest())
                decoded.append(back.hexdigest())
            return counts, digests, decoded

        return run

    return map_rows(df, [id_col], [text_col], "n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def _is_whole(token: bytes) -> bool:
    try:
        return StreamDecoder.run(0, token)[0] == 0
    except UnicodeDecodeError:
        return False


def token_ids(df: DataFrame, ranks_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the ids of each text as an array column, in place of a column of that name."""

    def make():
        enc = encoder(ranks_path)
        return lambda texts: ([x.astype(np.int32) for x in enc.encode([t or "" for t in texts])],)

    return map_rows(df, df.columns, [text_col], f"{ids_col} array<int>", make)


def ids_crc32(ids: np.ndarray) -> int:
    """crc32 of the ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
