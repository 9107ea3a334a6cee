"""Byte-level BPE: pre-tokenising by scans of transition functions, cached pair merging, decoding by offsets.

Pre-tokens are the matches of the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

found without a regex.  Each code point becomes one of few symbols (its class, plus what the one or two code
points after it decide: a contraction starts here, white space ends here).  A symbol is a function on the
states of a small automaton; the functions that arise from composing them form a finite monoid, so composing is a
lookup in one table.  Composition is associative: blocks of the text are folded side by side, the blocks' functions
are scanned by doubling, and the states inside all blocks then follow at once.  The state before a code
point and its symbol say whether a pre-token starts there.

Each distinct pre-token's bytes are merged once and cached (a bounded cache).  Nulls count as empty texts: no
tokens.  Repeated rows are encoded each for itself.  Input columns named ``token_ids``, ``n_tokens``,
``ids_sha256``, ``decoded_sha256`` or ``token_ends`` are replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import arrow, pieces, read_table, ship, utf8

# --- automaton ------------------------------------------------------------------------------------------------

LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
#: The code points of \s.
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# States: what the code point before was part of.
S_START, S_LETTER, S_NUMBER, S_OTHER, S_PREFIX, S_WHITE, S_ONE, S_TWO = range(8)
# Symbols: classes, white space in a run's middle or its end, and contractions of two or three characters.
SYMBOLS = ("letter", "number", "other", "space_mid", "white_mid", "space_end", "white_end", "short", "long")
_LETTER, _NUMBER, _OTHER, _SPACE_MID, _WHITE_MID, _SPACE_END, _WHITE_END, _SHORT, _LONG = range(9)


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a pre-token starts at this code point."""
    if symbol in (_SPACE_MID, _WHITE_MID):
        return S_WHITE, state != S_WHITE
    if symbol == _SPACE_END:
        return S_PREFIX, True
    if symbol == _WHITE_END:
        return S_START, True
    if state == S_TWO:
        return S_ONE, False
    if state == S_ONE:
        return S_START, False
    if symbol in (_SHORT, _LONG) and state not in (S_OTHER, S_PREFIX):
        return (S_ONE if symbol == _SHORT else S_TWO), True
    kind = {_LETTER: S_LETTER, _NUMBER: S_NUMBER}.get(symbol, S_OTHER)
    return kind, state not in (kind, S_PREFIX)


@functools.cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables: element of each symbol, composition, element's map of states, next state, whether a token starts.

    Symbols from 9 on are the same at the start of a document: they forget the state before.
    """
    n, k = 8, len(SYMBOLS)
    nxt, cut = np.zeros((2 * k, n), np.uint8), np.zeros((2 * k, n), bool)
    for y in range(2 * k):
        for s in range(n):
            nxt[y, s], cut[y, s] = step(s, y) if y < k else (step(S_START, y - k)[0], True)
    found = {tuple(range(n)): 0}
    order = [tuple(range(n))]
    for f in order:
        for y in range(2 * k):
            g = tuple(int(nxt[y, s]) for s in f)
            if g not in found:
                found[g] = len(order)
                order.append(g)
    maps = np.array(order, np.uint8)
    then = np.array([[found[tuple(int(x) for x in b[a])] for b in maps] for a in maps], np.int32)
    of = np.array([found[tuple(int(x) for x in nxt[y])] for y in range(2 * k)], np.int32)
    return of, then, maps, nxt, cut


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(0x110000):
        k = kinds.get(unicodedata.category(chr(c))[0])
        if k is not None:
            table[c] = k
    table[list(WHITE_SPACE)] = WHITE
    table[0x20] = SPACE
    return table


def symbols_of(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbol of each code point; ``first`` marks the starts of documents."""
    kind = classes()[points]
    n = len(points)
    white = kind >= SPACE
    nxt_inside = np.zeros(n, bool)  # a code point of the same document follows
    nxt_inside[:-1] = ~first[1:]
    follow_black = np.zeros(n, bool)
    follow_black[:-1] = nxt_inside[:-1] & ~white[1:]
    out = np.array([_LETTER, _NUMBER, _OTHER, _SPACE_MID, _WHITE_MID], np.uint8)[kind]
    out[white & follow_black] += 2
    quote = np.flatnonzero((points == 0x27) & nxt_inside)
    if len(quote):
        a = points[quote + 1]
        far = quote + 2 < n
        b = np.where(far & nxt_inside[np.minimum(quote + 1, n - 1)], points[np.minimum(quote + 2, n - 1)], 0)
        out[quote[np.isin(a, [ord(c) for c in "stmd"])]] = _SHORT
        out[quote[((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]] = _LONG
    return out + np.uint8(len(SYMBOLS)) * first


def token_starts(points: np.ndarray, first: np.ndarray, block: int = 64) -> np.ndarray:
    """Whether a pre-token starts at each code point, by a blocked scan of transition functions."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    of, then, maps, nxt, cut = monoid()
    symbols = symbols_of(points, first)
    width = -(-n // block)
    grid = np.zeros(width * block, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(width, block).T)  # row r: the r-th code point of all blocks
    size = len(then)
    flat, parts = then.reshape(-1), of[grid]
    whole = parts[0]
    for r in range(1, block):
        whole = flat[whole * size + parts[r]]
    hop = 1
    while hop < width:  # inclusive scan by doubling
        whole = np.concatenate((whole[:hop], flat[whole[:-hop] * size + whole[hop:]]))
        hop *= 2
    state = np.empty(width, np.intp)
    state[0] = S_START
    state[1:] = maps[whole[:-1], S_START]
    out = np.empty((block, width), bool)
    flat_next, flat_cut = nxt.reshape(-1).astype(np.intp), cut.reshape(-1)
    for r in range(block):
        at = grid[r].astype(np.intp) * 8 + state
        out[r] = flat_cut[at]
        state = flat_next[at]
    return out.T.reshape(-1)[:n]


# --- merging --------------------------------------------------------------------------------------------------


NEVER = 1 << 40


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the adjacent pair of lowest rank, leftmost first, is merged until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 64:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get = ranks.get
    pairs = [get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs:
        low = min(pairs)
        if low == NEVER:
            break
        i = pairs.index(low)
        parts[i] += parts.pop(i + 1)
        pairs.pop(i)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], NEVER)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], NEVER)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap over a linked list, for pieces where a search for the minimum would be quadratic."""
    n = len(piece)
    end, nxt, prev = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, length = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or end[j] - i != length:
            continue
        alive[j] = False
        end[i], nxt[i] = end[j], nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        for a in (prev[i], i):
            b = nxt[a] if a >= 0 else n
            if b < n and (r := ranks.get(piece[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b] - a))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = nxt[i]
    return out


class Coder:
    """Encodes and decodes by a file of ranks; the cache of merged pieces is bounded."""

    def __init__(self, path: str, most: int = 24 << 20):
        """``most``: bytes that the cache may take before it starts anew."""
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.vocabulary = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.vocabulary[rank] = piece
        self.sizes = np.array([len(x) for x in self.vocabulary], np.int64)
        self.most = most
        self.names = list(map(str, range(len(self.vocabulary))))
        self.cache: dict[bytes, int] = {}
        self.held = 0

        self.bytes_of = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for piece, rank in self.ranks.items():
            for cut in range(1, len(piece)):
                a, b = self.ranks.get(piece[:cut]), self.ranks.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], NEVER)

    def merge_many(self, parts: list[bytes]) -> list[tuple[int, ...]]:
        """``merge`` for many pieces side by side: each round merges one pair in every piece that has one left."""
        done: dict[int, tuple[int, ...]] = {}
        live = []
        for i, p in enumerate(parts):
            whole = self.ranks.get(p)
            if whole is not None:
                done[i] = (whole,)
            elif len(p) > 64:
                done[i] = tuple(_merge_long(p, self.ranks))
            else:
                live.append(i)
        live = np.array(live, np.int64)
        ids = self.bytes_of[np.frombuffer(b"".join(parts[i] for i in live.tolist()), np.uint8)]
        size = np.array([len(parts[i]) for i in live.tolist()], np.int64)
        begin = np.cumsum(size) - size
        # the rank of each id with its right neighbour; the last of a piece has none
        rank = np.full(len(ids), NEVER, np.int64)
        rank[:-1] = self.pair_ranks(ids[:-1], ids[1:]) if len(ids) else NEVER
        rank[begin + size - 1] = NEVER
        while len(live):
            low = np.minimum.reduceat(rank, begin)
            ended = low == NEVER
            if ended.any():
                for k in np.flatnonzero(ended).tolist():
                    done[int(live[k])] = tuple(ids[begin[k] : begin[k] + size[k]].tolist())
                stay = np.repeat(~ended, size)
                ids, rank, live, size, low = ids[stay], rank[stay], live[~ended], size[~ended], low[~ended]
                begin = np.cumsum(size) - size
                if not len(live):
                    break
            hits = np.flatnonzero(rank == np.repeat(low, size))
            owner = np.searchsorted(begin, hits, "right") - 1
            at = hits[np.append(True, owner[1:] != owner[:-1])]  # the leftmost of each piece
            ids[at] = low
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, rank = ids[keep], rank[keep]
            at = at - np.arange(len(at))
            size = size - 1
            begin = np.cumsum(size) - size
            last = begin + size - 1
            rank[at] = self.pair_ranks(ids[at], ids[np.minimum(at + 1, len(ids) - 1)])
            left = at[at > begin] - 1
            rank[left] = self.pair_ranks(ids[left], ids[left + 1])
            rank[last] = NEVER
        return [done[i] for i in range(len(parts))]

    def rows_of(self, parts: list[bytes]) -> np.ndarray:
        """The row of each piece in the cached ids (``flat`` from ``begin[row]`` to ``begin[row + 1]``)."""
        if self.held > self.most:
            self.cache, self.held = {}, 0
        cache = self.cache
        new = list(set(parts).difference(cache))
        if new:
            found = self.merge_many(new)
            old = len(cache)
            if not old:
                self.begin, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(sizes)))
            self.flat = np.concatenate((self.flat, np.fromiter(itertools.chain.from_iterable(found), np.int32, int(sizes.sum()))))
            cache.update(zip(new, range(old, old + len(new)), strict=True))
            self.held += 130 * len(new) + sum(map(len, new)) + 4 * int(sizes.sum())  # an entry, its bytes and its ids
        return np.fromiter(map(cache.__getitem__, parts), np.int64, len(parts))

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of UTF-8 text, one after another, and each document's offsets in them."""
        at = at - at[0]
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # the byte at which each code point starts
        first = np.zeros(len(points) + 1, bool)
        begins = np.searchsorted(lead, at)
        first[begins] = True
        starts = np.flatnonzero(token_starts(points, first[:-1]))
        cuts = np.append(lead[starts], len(data)).tolist()
        rows = self.rows_of([raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        sizes = self.begin[rows + 1] - self.begin[rows]
        lengths = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(sizes, out=lengths[1:])
        ids = self.flat[np.arange(lengths[-1]) + np.repeat(self.begin[rows] - lengths[:-1], sizes)]
        return ids, lengths[np.searchsorted(starts, begins)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids.tolist()))


@functools.cache
def coder(name: str) -> Coder:
    return Coder(_path(name))


def _path(name: str) -> str:
    """``name`` is a path, or the name of a file of the installed public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


PIECE = 1 << 18
MADE = [("token_ids", T.ArrayType(T.IntegerType())), ("token_ends", T.ArrayType(T.LongType())), ("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]


def _encode(batches: Iterator[pa.RecordBatch], name: str, text: str, keep: list[str], want: list[str]) -> Iterator[pa.RecordBatch]:
    code = coder(name)
    for batch in batches:
        data, at = utf8(batch.column(batch.schema.get_field_index(text)))
        for i, j in pieces(at, PIECE):  # the scans take some 100 bytes for each of text
            ids, ends = code.encode(data[at[i] : at[j]], at[i : j + 1])
            ends = ends.tolist()
            made = {"n_tokens": pa.array(np.diff(ends), pa.int64())}
            if "token_ids" in want:
                made["token_ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
            if "token_ends" in want:  # byte offsets at which tokens end in their document
                upto = np.concatenate(([0], np.cumsum(code.sizes[ids])))
                made["token_ends"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(upto[1:] - np.repeat(upto[ends[:-1]], np.diff(ends))))
            if "ids_sha256" in want:
                made["ids_sha256"] = pa.array([hashlib.sha256(" ".join(map(code.names.__getitem__, ids[a:b].tolist())).encode()).hexdigest() for a, b in zip(ends, ends[1:], strict=False)])
            if "decoded_sha256" in want:
                made["decoded_sha256"] = pa.array([hashlib.sha256(code.decode(ids[a:b])).hexdigest() for a, b in zip(ends, ends[1:], strict=False)])
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in keep] + [made[c] for c in want], names=keep + want)


def encode(docs: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", keep: list[str] | None = None, want: tuple[str, ...] = ("token_ids", "token_ends", "n_tokens")) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) with the ``want`` columns of MADE."""
    ship(docs.sparkSession)
    names = [c for c in (docs.columns if keep is None else keep) if c not in want or c == text]
    columns = list(dict.fromkeys([*names, text]))
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(n, t) for n, t in MADE if n in want])
    want_in_order = [n for n, _ in MADE if n in want]
    return arrow(docs.select(*columns), lambda it: _encode(it, vocabulary, text, names, want_in_order), schema)


def _decode(batches: Iterator[pa.RecordBatch], name: str, ids: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    code = coder(name)
    for batch in batches:
        rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
        raw = [b"".join(map(code.vocabulary.__getitem__, r or ())) for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(raw, pa.binary())], names=[*keep, "decoded"])


def decode(tokens: DataFrame, ids: str = "token_ids", vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``tokens`` with ``decoded``, the bytes of its ids; null ids decode to nothing."""
    ship(tokens.sparkSession)
    keep = [c for c in tokens.columns if c != "decoded"]
    schema = T.StructType([tokens.schema[c] for c in keep] + [T.StructField("decoded", T.BinaryType())])
    return arrow(tokens, lambda it: _decode(it, vocabulary, ids, keep), schema)


def digests(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document its number of tokens and the digests of its ids and of the bytes they decode to."""
    return encode(docs, text, keep=list(keep), want=("n_tokens", "ids_sha256", "decoded_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
