"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

Pre-tokenisation uses no regular expression. Every code point gets a class from a table; class and a look-ahead of three
characters give a symbol; a symbol is a transition function of a small automaton. Functions compose associatively, so
the state after every character comes from a blocked scan over function numbers with a table of compositions. State
before and symbol at a character say whether a piece begins there. Pieces are byte slices that look their ids up in a
bounded cache; what isn't there is merged pair by pair in order of rank. The byte offset of each id in its text is kept;
decoding puts every token at its offset.

No text is matched with a regular expression. The table of classes is read off the library's own character classes once
for each worker, over all code points, so that it holds the same version of Unicode as the results that are to be met.

Texts are worked on in chunks that begin at a piece, so memory is bounded by the chunk (or the longest piece), and the
hashes of ids and decoded bytes are carried along.

Defined cases: a null text counts as empty (no ids; hashes of nothing); ids may have any type, and a null id is passed on; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

CHUNK_CHARS = 1 << 18
CACHE_PIECES = 1 << 16
CACHED_BYTES = 64  # longer pieces are merged each time
_NEVER = 1 << 40

# Classes of code points.
OTHER, LETTER, NUMBER, SPACE, BLANK = range(5)  # SPACE: white space other than U+0020; BLANK: U+0020
# States: what the piece is that the last character belongs to.
ST_START, ST_LETTER, ST_NUMBER, ST_OTHER, ST_WHITE, ST_LAST_WHITE, ST_BLANK, ST_ONE_MORE, ST_TWO_MORE, ST_SUFFIXED = range(10)
# Symbols: class and what follows.
SY_LETTER, SY_NUMBER, SY_OTHER, SY_QUOTE1, SY_QUOTE2, SY_WHITE, SY_LAST_SPACE, SY_LAST_BLANK = range(8)
#: The suffixes of the pattern that an apostrophe at the begin of a piece takes along.
SUFFIX1, SUFFIX2 = "stmd", ("re", "ve", "ll")


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """State after a character, and whether a piece begins at it."""
    if symbol == SY_LETTER:
        if state == ST_TWO_MORE:
            return ST_ONE_MORE, False
        if state == ST_ONE_MORE:
            return ST_SUFFIXED, False
        return ST_LETTER, state not in (ST_LETTER, ST_BLANK)
    if symbol == SY_NUMBER:
        return ST_NUMBER, state not in (ST_NUMBER, ST_BLANK)
    if symbol == SY_OTHER:
        return ST_OTHER, state not in (ST_OTHER, ST_BLANK)
    if symbol in (SY_QUOTE1, SY_QUOTE2):
        if state in (ST_OTHER, ST_BLANK):
            return ST_OTHER, False
        return (ST_ONE_MORE if symbol == SY_QUOTE1 else ST_TWO_MORE), True
    if symbol == SY_WHITE:
        return ST_WHITE, state != ST_WHITE
    return (ST_LAST_WHITE if symbol == SY_LAST_SPACE else ST_BLANK), True


@functools.cache
def _monoid() -> tuple[np.ndarray, ...]:
    """Function number of each symbol, and of each symbol at the begin of a text (then whatever came before is forgotten);
    numbers composed (first, then second); state after a function from the start; begins by state and symbol."""
    symbols, states = range(8), range(10)
    known: dict[tuple[int, ...], int] = {}
    of_symbol = [known.setdefault(tuple(_step(s, y)[0] for s in states), len(known)) for y in symbols]
    restart = [known.setdefault((_step(ST_START, y)[0],) * len(states), len(known)) for y in symbols]
    work = list(known)
    generators = list(known)
    while work:
        f = work.pop()
        for g in generators:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                work.append(h)
    functions = list(known)
    table = np.array([[known[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint8)
    after = np.array([f[ST_START] for f in functions], np.uint8)
    begins = np.array([[_step(s, y)[1] for y in symbols] for s in states], bool)
    return np.array(of_symbol, np.uint8), np.array(restart, np.uint8), table, after, begins


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point, by the Unicode tables of the library whose results are to be met."""
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        for low in range(0, 0x110000, 1 << 14):  # in parts, as a worker has little memory
            points = "".join(chr(c) for c in range(low, low + (1 << 14)) if not 0xD800 <= c < 0xE000)
            out[_points(probe.decode_bytes(probe.encode_ordinary(points)).decode())] = kind
    out[0x20] = BLANK
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _symbols(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Symbol of each character; no look-ahead goes past the end of a text."""
    kind = _classes()[points]
    n = len(kind)
    last = np.zeros(n, bool)
    last[firsts[1:] - 1] = True
    last[-1] = True
    white = kind >= SPACE
    white_next = np.append(white[1:], True) | last
    symbol = np.array([SY_OTHER, SY_LETTER, SY_NUMBER, SY_LAST_SPACE, SY_LAST_BLANK], np.uint8)[kind]
    symbol[white & white_next] = SY_WHITE
    quote = np.flatnonzero((points == 39) & ~last)
    if len(quote):
        a = points[quote + 1]
        b = np.where(last[quote + 1], 0, points[np.minimum(quote + 2, n - 1)])
        symbol[quote[np.isin(a, [ord(c) for c in SUFFIX1])]] = SY_QUOTE1
        for x, y in SUFFIX2:
            symbol[quote[(a == ord(x)) & (b == ord(y))]] = SY_QUOTE2
    return symbol


def _scan(functions: np.ndarray, table: np.ndarray) -> np.ndarray:
    """All prefixes of the composition: columns of a square side by side, then the totals of the rows."""
    n = len(functions)
    if n < 64:
        out = functions.copy()
        for i in range(1, n):
            out[i] = table[out[i - 1], out[i]]
        return out
    width = int(np.sqrt(n)) + 1
    rows = -(-n // width)
    square = np.zeros(rows * width, np.uint8)
    square[:n] = functions
    square = np.ascontiguousarray(square.reshape(rows, width).T)
    for i in range(1, width):
        square[i] = table[square[i - 1], square[i]]
    before = square[-1].copy()
    for i in range(1, rows):
        before[i] = table[before[i - 1], before[i]]
    square[:, 1:] = table[before[None, :-1], square[:, 1:]]
    return square.T.reshape(-1)[:n]


def starts(points: np.ndarray, firsts: np.ndarray | None = None) -> np.ndarray:
    """Where pieces begin, in characters; ``firsts``: where texts begin, 0 among them."""
    if not len(points):
        return np.zeros(0, np.int64)
    firsts = np.zeros(1, np.int64) if firsts is None else firsts
    of_symbol, restart, table, after, begins = _monoid()
    symbol = _symbols(points, firsts)
    functions = of_symbol[symbol]
    functions[firsts] = restart[symbol[firsts]]
    state = after[_scan(functions, table)]
    before = np.empty_like(state)
    before[1:] = state[:-1]
    before[firsts] = ST_START
    return np.flatnonzero(begins[before, symbol])


def _bytes_at(points: np.ndarray, at: np.ndarray, n_bytes: int) -> np.ndarray:
    """Byte offsets of characters."""
    if n_bytes == len(points):
        return at
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    return np.concatenate(([0], np.cumsum(width)))[at]


class Codec:
    """Encodes and decodes by a file of ranks; keeps at most twice ``cache_pieces`` merged pieces."""

    def __init__(self, ranks: str | bytes, cache_pieces: int = CACHE_PIECES, chunk_chars: int = CHUNK_CHARS):
        """``ranks``: the lines of the file, or its path."""
        if isinstance(ranks, str):
            ranks = Path(ranks).read_bytes()
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        self.vocabulary = [b""] * (max(self.ranks.values()) + 1)
        for piece, i in self.ranks.items():
            self.vocabulary[i] = piece
        # All tokens one behind the other, for decoding many at once.
        self.flat = np.frombuffer(b"".join(self.vocabulary), np.uint8)
        self.sizes = np.fromiter(map(len, self.vocabulary), np.int64, len(self.vocabulary))
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.chunk_chars, self.cache_pieces = chunk_chars, cache_pieces
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        # Pairs of ids that merge: sorted keys, and the id that each makes.
        size = len(self.vocabulary)
        pairs = [(left * size + right, i) for piece, i in self.ranks.items() for k in range(1, len(piece)) if (left := self.ranks.get(piece[:k])) is not None and (right := self.ranks.get(piece[k:])) is not None]
        self.pairs, self.made = (np.array(x, np.int64) for x in zip(*sorted(pairs)))
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)

    def lookup(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece."""
        got = list(map(self.cache.get, pieces))
        missing = {p for p, g in zip(pieces, got) if g is None}
        if not missing:
            return got
        found = {p: g for p in missing if (g := self.older.get(p)) is not None}
        fresh = [p for p in missing if p not in found]
        found.update(zip(fresh, self.merge_many(fresh)))
        if len(self.cache) + len(found) > self.cache_pieces:
            self.cache, self.older = {}, self.cache
        if len(found) <= self.cache_pieces:
            self.cache.update((p, g) for p, g in found.items() if len(p) <= CACHED_BYTES)
        return [found[p] if g is None else g for p, g in zip(pieces, got)]

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """``merge`` for many pieces at once, packed: rows of a matrix merge their best pair together, round by round."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(piece) > CACHED_BYTES:
                out[k] = np.array(self.merge(piece), "<u4").tobytes()
            else:
                by_width.setdefault(-(-len(piece) // 4) * 4, []).append(k)
        for width, all_rows in by_width.items():
            for at in range(0, len(all_rows), 8192):
                rows = all_rows[at : at + 8192]
                packed, counts = self._merge_rows([pieces[k] for k in rows], width)
                for k, row, n in zip(rows, packed, counts.tolist()):
                    out[k] = row[:n].tobytes()
        return out

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * len(self.vocabulary) + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.made[at], _NEVER)

    def _merge_rows(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = np.where(np.arange(width) < size[:, None], self.single[raw], -1)
        rank = np.full((n, width), _NEVER)
        rank[:, :-1] = self._rank_of(ids[:, :-1], ids[:, 1:])
        live = np.arange(n)
        column = np.arange(width)
        while len(live):
            part = rank[live]
            at = part.argmin(1)
            best = part[np.arange(len(live)), at]
            go = best < _NEVER
            live, at, best = live[go], at[go], best[go]
            if not len(live):
                break
            # Close the gap behind the merged pair.
            take = np.minimum(column + (column > at[:, None]), width - 1)
            moved = np.take_along_axis(ids[live], take, 1)
            moved[:, -1] = -1
            moved[np.arange(len(live)), at] = best
            ranks = np.take_along_axis(rank[live], take, 1)
            ranks[:, -1] = _NEVER
            here, after = np.arange(len(live)), np.minimum(at + 1, width - 1)
            ranks[here, at] = np.where(at + 1 < width, self._rank_of(best, moved[here, after]), _NEVER)
            left = np.maximum(at - 1, 0)
            ranks[here, left] = np.where(at > 0, self._rank_of(moved[here, left], best), ranks[here, left])
            ids[live], rank[live] = moved, ranks
            size[live] -= 1
        return ids.astype("<u4"), size

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: of all neighbours the pair of the lowest rank is merged first, the leftmost of equals."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        if n <= CACHED_BYTES:
            parts = [piece[i : i + 1] for i in range(n)]
            pair = [ranks.get(piece[i : i + 2], 1 << 30) for i in range(n - 1)]
            while pair:
                low = min(pair)
                if low == 1 << 30:
                    break
                i = pair.index(low)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del pair[i]
                if i < len(pair):
                    pair[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
                if i:
                    pair[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
            return [ranks[p] for p in parts]
        # Long pieces: a heap of pairs over a linked list.
        end = list(range(1, n + 1))  # of the part that begins here
        prev = list(range(-1, n))
        alive = bytearray([1]) * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            end[i] = stop
            alive[j] = 0
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Packed ids (little-endian, 32 bits) of each text; for texts that fit into memory together."""
        whole = "".join(texts)
        if not whole:
            return [b""] * len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        edges = np.concatenate(([0], np.cumsum(sizes)))
        points = _points(whole)
        begin = starts(points, edges[:-1][sizes > 0])
        raw = whole.encode()
        cuts = np.append(_bytes_at(points, begin, len(raw)), len(raw)).tolist()
        packed = self.lookup([raw[a:b] for a, b in itertools.pairwise(cuts)])
        return [b"".join(packed[a:b]) for a, b in itertools.pairwise(np.searchsorted(begin, edges).tolist())]

    def chunks(self, text: str) -> Iterator[bytes]:
        """Packed ids of successive stretches of one text that begin and end with pieces."""
        at, size, n = 0, self.chunk_chars, len(text)
        while n - at > size + 3:
            points = _points(text[at : at + size + 3])
            # Three characters of look-ahead settle everything up to ``size``; the piece that may go on is left.
            begin = starts(points)
            begin = begin[begin <= size]
            if len(begin) < 2:
                size *= 2
                continue
            stop = int(begin[-1])
            raw = text[at : at + stop].encode()
            cuts = _bytes_at(points, begin, len(raw) + len(points) - stop).tolist()
            yield b"".join(self.lookup([raw[a:b] for a, b in itertools.pairwise(cuts)]))
            at += stop
        if at < n:
            yield self.encode_many([text[at:]])[0]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte offset of each id in the text that they encode, and the length behind them."""
        return np.concatenate(([0], np.cumsum(self.sizes[ids])))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the byte offset of each id in the text (one more: the length)."""
        ids = np.frombuffer(b"".join(self.chunks(text)), "<u4")
        return ids, self.offsets(ids)

    def decode(self, ids, offsets: np.ndarray | None = None) -> bytes:
        """The bytes of the ids, each put at its offset."""
        ids = np.asarray(ids, np.int64)
        offsets = self.offsets(ids) if offsets is None else offsets
        shift = np.repeat(self.begins[ids] - offsets[:-1], np.diff(offsets))
        return self.flat[np.arange(len(shift)) + shift].tobytes()


@functools.lru_cache(maxsize=2)
def codec(ranks: bytes) -> Codec:
    """One for each Python worker, so the cache outlives a task."""
    return Codec(ranks)


def _shipped(df: DataFrame, path: str) -> Broadcast:
    """The lines of the file, which only the driver has to see."""
    ship(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def _blocks(texts: pa.Array, chunk_chars: int) -> Iterator[tuple[int, list[str]]]:
    """Successive texts that together stay near the chunk size, each with the number of its first."""
    at, block, size = 0, [], 0
    for k, text in enumerate(texts):
        text = text.as_py() or ""
        if block and size + len(text) > chunk_chars:
            yield at, block
            at, block, size = k, [], 0
        block.append(text)
        size += len(text)
    if block:
        yield at, block


def _digests(batches: Iterator[pa.RecordBatch], c: Codec) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        schema = pa.schema([("doc_id", batch.column(0).type), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        for at, texts in _blocks(batch.column(1), c.chunk_chars):
            rows = []
            each = ([x] for x in c.encode_many(texts)) if len(texts) > 1 else (c.chunks(t) for t in texts)
            for chunks in each:
                n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
                for packed in chunks:
                    ids = np.frombuffer(packed, "<u4")
                    n += len(ids)
                    of_ids.update(packed)
                    of_text.update(c.decode(ids, c.offsets(ids)))
                rows.append((n, of_ids.hexdigest(), of_text.hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *(pa.array(x, t) for x, t in zip(zip(*rows), schema.types[1:]))], schema=schema)


def encode_ids(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and byte offsets of the ids, whole texts."""
    held = _shipped(df, path)

    def run(batches):
        c = codec(held.value)
        for batch in batches:
            schema = pa.schema([("doc_id", batch.column(0).type), ("ids", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64()))])
            for at in range(batch.num_rows):
                ids, offsets = c.encode(batch.column(1)[at].as_py() or "")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), pa.array([ids.astype(np.int32)], schema.types[1]), pa.array([offsets], schema.types[2])], schema=schema)

    two = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return two.mapInArrow(run, f"doc_id {two.dtypes[0][1]}, ids array<int>, offsets array<long>")


def decode_ids(df: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded bytes of the rows of ``encode_ids``."""
    held = _shipped(df, path)

    def run(batches):
        c = codec(held.value)
        for batch in batches:
            schema = pa.schema([("doc_id", batch.column(0).type), ("decoded", pa.binary())])
            for at in range(batch.num_rows):
                ids, offsets = (batch.column(k)[at].values.to_numpy() for k in (1, 2))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), pa.array([c.decode(ids, offsets)], pa.binary())], schema=schema)

    three = df.select("doc_id", "ids", "offsets")
    return three.mapInArrow(run, f"doc_id {three.dtypes[0][1]}, decoded binary")


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes every whole text and decodes the ids again."""
    held = _shipped(df, path)
    two = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return two.mapInArrow(lambda batches: _digests(batches, codec(held.value)), f"doc_id {two.dtypes[0][1]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
