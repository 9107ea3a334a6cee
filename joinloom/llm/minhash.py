r"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

Weights: a shingle of five words (``[^\x20\x09-\x0D]+``; a shorter text is one shingle) weighs its count in the text
times its idf, 1 + ``DAMPING`` * ln(1 / p) / ln(1 / RARE), where p is the share of documents that hold it, ``RARE`` at
least.  It lies between 1 and 1 + DAMPING: an undamped idf would pull a large group of near copies apart, as what
they share is frequent only because they share it, while each one's edits weigh most.  All shingles of all documents are
counted in a sketch of ``ROWS_OF_CELLS`` rows of ``CELLS`` cells; the mean load of a cell is taken off and the lowest row
counts.  What is left of a cell's noise is a share of the documents that doesn't depend on their number, as p and RARE
are; so the weights are alike at every size, and the table may be broadcast.

1. One pass samples each text ``DRAWS`` times by improved consistent weighted sampling: with r, c ~ Gamma(2, 1)
   and beta uniform for each shingle and draw, t = floor(ln w / r + beta), ln a = ln c - r (t - beta + 1), and the
   sample is (shingle, t) of the least a; two texts agree in a draw with the probability of their weighted Jaccard.
2. Equal texts are one class by digest; only its smallest doc_id goes on.
3. In a bucket (band of ``ROWS`` samples) the most central text leads and is paired with all that agree with it in at
   least ``agree`` of their samples, then the most central of the rest, and so on.  Buckets are dealt by hash into parts
   of about ``SALT`` texts; the leaders of a bucket's parts meet again until they fit one.  That is one pair a text and bucket at most.
4. Pairs are verified by the weighted Jaccard of their whole texts (``SIMILARITY``); links give components.
5. Buckets that still hold several components are taken together by their largest component.  Every text outside it is
   compared with all texts of these buckets, first by samples, to find which texts are in question at all, then by
   their words: of each two components, the pairs that agree in at least ``agree`` samples are verified, the best
   first, until one links them.  Only links that join components come out, so what comes out grows with the texts and
   not with the pairs.  A link inside a bucket is lost only if its samples agree less than ``agree`` (at a similarity of
   exactly 0.8 one in 1,000); ``agree=0`` verifies all.

Every shuffle is of digests, samples or of the texts of candidates; nothing is collected but the sketch and a Bloom
filter of bounded size, which keeps texts that are no candidates out of a shuffle.
Texts without a word (null, empty, white space) and rows with a null doc_id are never duplicates.  A class holds texts:
rows that share a doc_id and differ in their texts have the class of their own text each.  Extra columns, whatever
their names, pass through ``dedup`` and are ignored otherwise.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Hashes, arrow, discard, mix, pieces, read_table, seeded, ship, total, utf8, words_of, written
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
DAMPING = 0.2
RARE = 0.001
BANDS, ROWS = 10, 3
#: The first BANDS * ROWS draws make the bands; all of them tell whether a pair is worth verifying.
DRAWS = 64
AGREE = 41
ROWS_OF_CELLS = 2
CELL_BITS = 20
CELLS = 1 << CELL_BITS
SALT = 4096
HUB = 256
#: Bytes of text that ask at once, and texts that are asked, in a task of step 5.
ASKS, TOLD = 1 << 23, 4096
#: The Bloom filter has 16 bits a text, up to so many in all; beyond that it lets more texts through.
MOST_BITS = 1 << 27
_U = np.uint64


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of documents one after another, sorted within each, and each document's offsets."""
    start, end, first = words_of(data, at)
    word = Hashes(data).of(start, end)
    factor = seeded(SHINGLE, 11) | _U(1)
    n_words = np.diff(first)
    counts = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, (n_words > 0).astype(np.int64))
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    padded = np.concatenate((word, np.zeros(SHINGLE, _U)))
    begin = np.repeat(first[:-1] - offsets[:-1], counts) + np.arange(offsets[-1])
    left = np.repeat(first[1:], counts) - begin  # words from here to the document's end
    out = np.zeros(len(begin), _U)
    short = bool((left < SHINGLE).any())
    for k in range(SHINGLE):
        part = padded[begin + k] * factor[k]
        out += np.where(left > k, part, _U(0)) if short else part
    out = mix(out)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out[a:b].sort()
    return out, offsets


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, their counts and each document's offsets in them."""
    f, offsets = shingles(data, at)
    if not len(f):
        return f, np.zeros(0, np.int64), offsets
    new = np.ones(len(f) + 1, bool)
    new[1:-1] = f[1:] != f[:-1]
    new[offsets] = True
    where = np.flatnonzero(new[:-1])
    return f[where], np.diff(np.append(where, len(f))), np.searchsorted(where, offsets)


# --- idf ------------------------------------------------------------------------------------------------------


def _cells(f: np.ndarray) -> list[np.ndarray]:
    """The cell of each shingle in each row of the sketch."""
    at = [f >> _U(64 - CELL_BITS), (f << _U(CELL_BITS)) >> _U(64 - CELL_BITS)]
    return [x.astype(np.int64) + k * CELLS for k, x in enumerate(at)]


def _count(table: np.ndarray, batch: pa.RecordBatch) -> None:
    data, at = utf8(batch.column(0))
    for i, j in pieces(at):
        f = features(data[at[i] : at[j]], at[i : j + 1])[0]
        for k, cells in enumerate(_cells(f)):
            table[k * CELLS : (k + 1) * CELLS] += np.bincount(cells - k * CELLS, minlength=CELLS)


def idf_table(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The idf by cell, over all documents."""
    table, n = total(docs.select(text), _count, ROWS_OF_CELLS * CELLS, np.int64, np.add)
    load = table[:CELLS].sum() / CELLS  # what other shingles add to a cell on average
    share = np.maximum(table - load, 1) / max(n, 1)
    return (1 + DAMPING * np.log(1 / share.clip(RARE, 1)) / math.log(1 / RARE)).astype(np.float32)


def weights(f: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Of shingles with their counts."""
    return n * functools.reduce(np.maximum, [idf[cells] for cells in _cells(f)])


def _bits(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(ids.view(_U) + _U(0x9E3779B97F4A7C15))
    return (h & _U(size - 1)).astype(np.int64), ((h >> _U(32)) & _U(size - 1)).astype(np.int64)


def _bloom(ids: DataFrame):
    """A broadcast Bloom filter of ids (one column)."""
    size = min(MOST_BITS, 1 << max(16, (16 * ids.count()).bit_length()))

    def fill(table: np.ndarray, batch: pa.RecordBatch) -> None:
        for at in _bits(batch.column(0).to_numpy(), size):
            np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))

    return ids.sparkSession.sparkContext.broadcast(total(ids, fill, size // 8, np.uint8, np.bitwise_or)[0])


def _passing(rows: DataFrame, id_: str, bloom, passes: bool) -> DataFrame:
    """The rows whose id passes the filter, or those that certainly aren't in it; ids aren't null."""
    k = rows.columns.index(id_)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bloom.value
        for batch in batches:
            hit = np.ones(len(batch), bool)
            for at in _bits(batch.column(k).to_numpy(), 8 * len(bits)):
                hit &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            hit = hit == passes
            if hit.any():
                yield batch.filter(pa.array(hit))

    return arrow(rows, some, rows.schema)


def _texts_of(named: DataFrame, ids: DataFrame, several: DataFrame | None) -> DataFrame:
    """(id, text) of documents, all of ``ids`` among them: others pass a Bloom filter seldom.

    Where doc_ids repeat, ``several`` (id, doc, digest) says which text of which doc_id an id stands for.
    """
    rows = named.select(F.col("doc_id").alias("doc"), "text")
    if several is None:
        bloom = _bloom(ids)
        found = _passing(rows, "doc", bloom, True).withColumnRenamed("doc", "id")
    else:
        wanted = written(ids.join(several, "id"), "wanted")
        bloom = _bloom(wanted.select("doc").distinct())
        found = _passing(rows, "doc", bloom, True).withColumn("digest", F.unhex(F.md5("text"))).join(wanted, ["doc", "digest"]).groupBy("id").agg(F.first("text").alias("text"))
    out = written(found, "candidates")
    bloom.destroy()
    return out


# --- sampling -------------------------------------------------------------------------------------------------


@functools.cache
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gamma, log Gamma and uniform variates by 16 bits of a hash, and the draws' hash factors."""
    rng = np.random.default_rng(20)
    r = rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
    c = np.log(rng.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
    beta = rng.random(1 << 16, np.float32)
    return r, c, beta, seeded(DRAWS, 12) | _U(1)


def sample(f: np.ndarray, weight: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Samples (documents, DRAWS) as hashes; documents without shingles get zeros."""
    out = np.zeros((len(offsets) - 1, DRAWS), _U)
    some = np.flatnonzero(np.diff(offsets))
    if not len(some):
        return out
    r_, c_, beta_, factors = _draws()
    begin, size = offsets[some], np.diff(offsets)[some]
    log_w = np.log(weight)
    for j in range(DRAWS):
        at = (f * factors[j]) >> _U(48)
        r, beta = r_[at], beta_[at]
        t = np.floor(log_w / r + beta)
        a = c_[at] - r * (t - beta + 1)
        least = np.minimum.reduceat(a, begin)
        hit = np.flatnonzero(a == np.repeat(least, size))
        k = hit[np.searchsorted(hit, begin)]
        out[some, j] = mix(f[k] + t[k].astype(np.int64).astype(_U) * _U(0x9E3779B97F4A7C15))
    return out


_SAMPLED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("samples", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("size", T.LongType())])


def _sample(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row a document; those without a word have no digest."""
    factor = seeded(ROWS, 13) | _U(1)
    for batch in batches:
        data, at = utf8(batch.column(1))
        for i, j in pieces(at):
            own, ends = data[at[i] : at[j]], at[i : j + 1] - at[i]
            f, n, offsets = features(own, ends)
            got = sample(f, weights(f, n, idf), offsets)
            bands = mix((got[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS) * factor).sum(2, dtype=_U) + np.arange(BANDS, dtype=_U)).view(np.int64)
            raw, some = own.tobytes(), np.diff(offsets) > 0
            digests = [hashlib.md5(raw[a:b]).digest() if x else None for a, b, x in zip(ends, ends[1:], some, strict=False)]
            small = (got >> _U(56)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(i, j - i), pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in small], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i) * BANDS + 1, BANDS), pa.int32()), pa.array(bands.reshape(-1))),
                pa.array(np.diff(ends)),
            ], names=_SAMPLED.names)


# --- buckets --------------------------------------------------------------------------------------------------

#: b null: a leads in a part of a bucket of several parts; else a pair.
_MET = T.StructType([T.StructField("key", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, DRAWS)


def agreements(sig: np.ndarray, other: np.ndarray) -> np.ndarray:
    """In how many draws rows agree (one row on either side stands for all): bytes of a xor that are zero."""
    x = sig.view(_U) ^ other.view(_U)
    low = _U(0x7F7F7F7F7F7F7F7F)
    return DRAWS - np.bitwise_count((((x & low) + low) | x) & ~low).sum(-1, dtype=np.int64)


def agreeing(told: np.ndarray, asks: np.ndarray, agree: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that agree in ``agree`` draws or more.

    One bit of each sample makes a vector of signs; ``agree`` draws in common leave at most DRAWS - agree opposite
    signs, so a matrix product of the signs tells which pairs are worth counting.
    """
    signs = [(x & 1).astype(np.float32) * 2 - 1 for x in (told, asks)]
    i, j = np.nonzero(signs[0] @ signs[1].T >= 2 * agree - DRAWS - 0.5)
    hit = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        part = slice(k, k + (1 << 16))
        hit[part] = agreements(told[i[part]], asks[j[part]]) >= agree
    return i[hit], j[hit]


def cluster(sig: np.ndarray, agree: int) -> np.ndarray:
    """The leader of each text of a bucket (its own row for leaders), the most central texts leading first.

    Central is who agrees most with all the others: a leader near the middle of a group of near copies links to most of
    it, where an arbitrary one might link to none.
    """
    cell = sig + np.arange(sig.shape[1]) * 256
    central = np.bincount(cell.reshape(-1), minlength=sig.shape[1] * 256)[cell].sum(1)
    leader = np.full(len(sig), -1)
    for k in np.argsort(-central, kind="stable").tolist():
        if leader[k] < 0:
            open_ = np.flatnonzero(leader < 0)
            leader[open_[agreements(sig[open_], sig[k]) >= agree]] = k
            leader[k] = k
    return leader


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows of each key (the first ``keys`` columns, by which they are sorted) as one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        edge = np.flatnonzero(functools.reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])) + 1
        for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(batch)], strict=True):
            if held and any(held[-1].column(k)[0] != batch.column(k)[s] for k in range(keys)):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _lead(batches: Iterator[pa.RecordBatch], agree: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, parts, id, samples) sorted by key and part: a part of about SALT texts at a time."""
    rows: list[tuple] = []
    for group in _groups(batches, 2):
        key, parts = group.column(0)[0].as_py(), group.column(2)[0].as_py()
        ids = group.column(3).to_pylist()
        leader = cluster(_signatures(group.column(4)), agree).tolist()
        rows += [(key, ids[x], ids[k]) for k, x in enumerate(leader) if x != k]
        if parts > 1:
            rows += [(key, ids[k], None) for k, x in enumerate(leader) if x == k]
        if len(rows) > 20_000:
            yield _rows(rows, _MET)
            rows = []
    if rows:
        yield _rows(rows, _MET)


def _rows(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _stars(members: DataFrame, samples: DataFrame, agree: int) -> DataFrame:
    """Pairs (a, b) of texts and leaders of ``members`` (key, id, n): at most one a text and bucket."""
    tables, before = [], None
    while True:
        parts = F.ceil(F.col("n") / SALT).cast("int")
        dealt = members.join(samples, "id").select("key", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), parts.alias("parts"), "id", "samples")
        met = written(arrow(dealt.repartition("key", "part").sortWithinPartitions("key", "part", "id"), lambda it: _lead(it, agree), _MET), "met")
        tables.append(met)
        heads = met.where("b IS NULL").select("key", F.col("a").alias("id"))
        n = heads.count()
        if not n or before is not None and 2 * n > before:  # what hardly shrinks has little to agree on; step 5 compares it
            break
        before = n
        members = written(heads.join(heads.groupBy("key").agg(F.count("*").alias("n")), "key"), "heads")
    pairs = functools.reduce(DataFrame.unionByName, tables).where("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = written(pairs, "pairs")
    discard(*tables)
    return pairs


# --- verification ---------------------------------------------------------------------------------------------

_LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("similarity", T.DoubleType())])


def weighted_jaccard(f: np.ndarray, w: np.ndarray, g: np.ndarray, v: np.ndarray) -> float:
    """Of two weighted sets with sorted elements."""
    at = np.minimum(np.searchsorted(g, f), max(0, len(g) - 1))
    same = g[at] == f if len(g) else np.zeros(len(f), bool)
    low = float(np.minimum(w[same], v[at[same]]).sum())
    return low / (float(w.sum()) + float(v.sum()) - low) if low else 0.0


def _verify(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (hub, chunk, side, id, text) sorted by hub, chunk and side: a hub's text, then those paired with it."""
    now = hub = None
    for batch in batches:
        data, at = utf8(batch.column(4))
        key, chunk, side, rep = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        found: list[tuple[int, int, float]] = []
        for i, j in pieces(at):
            f, n, offsets = features(data[at[i] : at[j]], at[i : j + 1])
            w = weights(f, n, idf).astype(np.float64)
            for d in range(i, j):
                own = slice(offsets[d - i], offsets[d - i + 1])
                if side[d] == 0:
                    now, hub = (key[d], chunk[d]), (f[own].copy(), w[own].copy())
                elif hub is not None and now == (key[d], chunk[d]):
                    found.append((int(key[d]), int(rep[d]), weighted_jaccard(*hub, f[own], w[own])))
        if found:
            yield _rows(found, _LINK)


def _links(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """Verified pairs (a, b, similarity): a's text meets those of its pairs in chunks of about HUB."""
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB).cast("int").alias("chunks"))
    others = pairs.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("side"), F.col("b").alias("id")).join(texts, "id")
    heads = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), F.col("a").alias("id")).join(texts, "id")
    columns = ["a", "chunk", "side", "id", "text"]
    dealt = heads.select(*columns).unionByName(others.select(*columns)).repartition("a", "chunk").sortWithinPartitions("a", "chunk", "side")
    return arrow(dealt, lambda it: _verify(it, idf.value), _LINK).where(F.col("similarity") >= SIMILARITY)


# --- what is left between components --------------------------------------------------------------------------

_ASKED = T.StructType([T.StructField("main", T.LongType()), T.StructField("ask", T.IntegerType()), T.StructField("told", T.IntegerType()), T.StructField("side", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("comp", T.LongType()), T.StructField("samples", T.BinaryType())])


def _in_question(batches: Iterator[pa.RecordBatch], agree: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_ASKED`` sorted by main, ask, told and side (0: asks): those that agree with one of another component."""
    now, held, asks, comp, sig, hit = None, [], None, None, None, None

    def close() -> Iterator[pa.RecordBatch]:
        if hit is not None and hit.any():
            yield asks.filter(pa.array(hit))

    for whole in batches:
        if not len(whole):
            continue
        columns = [whole.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        edge = (np.flatnonzero(functools.reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])) + 1).tolist()
        for s, e in zip([0, *edge], [*edge, len(whole)], strict=True):
            key = tuple(int(c[s]) for c in columns[:3])
            if key != now:
                yield from close()
                now, held, hit = key, [], None
            if columns[3][s] == 0:
                held.append(whole.slice(s, e - s))
                continue
            if not held:
                continue
            if hit is None:
                asks = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                comp, sig = asks.column(5).to_numpy(), _signatures(asks.column(6))
                hit, most = np.zeros(len(asks), bool), max(16, (1 << 21) // len(asks))
            for k in range(s, e, most):
                told = whole.slice(k, min(most, e - k))
                i, j = agreeing(_signatures(told.column(6)), sig, agree)
                apart = told.column(5).to_numpy()[i] != comp[j]
                hit[j[apart]] = True
                some = np.unique(i[apart])
                if len(some):
                    yield told.take(pa.array(some))
    yield from close()


class _Block:
    """Texts that ask: their shingles by number, and the components they are in so far."""

    def __init__(self, rows: list[tuple]):
        self.ids, self.comp, sig, f, w = zip(*rows, strict=True)
        self.comp = np.array(self.comp)
        self.sig = np.stack(sig)
        sizes = np.array([len(x) for x in f])
        self.known, self.code = np.unique(np.concatenate(f), return_inverse=True)
        self.w = np.concatenate(w)
        self.at = np.concatenate(([0], np.cumsum(sizes)))
        self.total = np.add.reduceat(self.w, self.at[:-1])
        self.theirs = np.zeros(len(self.known) + 1)
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while x in self.parent:
            x = self.parent[x]
        return x

    def ask(self, rep: int, comp: int, sig: np.ndarray, f: np.ndarray, w: np.ndarray, agree: int) -> list[tuple[int, int, float]]:
        """Links that join components between this text and those that ask, the best pair of each component first."""
        out = []
        comp = self.root(comp)
        total = float(w.sum())
        may = np.flatnonzero((self.comp != comp) & (np.minimum(self.total, total) >= (SIMILARITY - 1e-9) * np.maximum(self.total, total)))
        score = agreements(self.sig[may], sig)
        order = np.argsort(-score, kind="stable")
        may = may[order[score[order] >= agree]]
        if not len(may):
            return out
        at = np.minimum(np.searchsorted(self.known, f), len(self.known) - 1)
        at[self.known[at] != f] = len(self.known)
        self.theirs[at] = w
        self.theirs[-1] = 0
        while len(may):
            _, best = np.unique(self.comp[may], return_index=True)
            tried = may[best]
            sizes = self.at[tried + 1] - self.at[tried]
            cut = np.cumsum(sizes) - sizes
            cell = np.arange(sizes.sum()) + np.repeat(self.at[tried] - cut, sizes)
            low = np.add.reduceat(np.minimum(self.w[cell], self.theirs[self.code[cell]]), cut)
            similarity = low / (self.total[tried] + total - low)
            for k in np.flatnonzero(similarity >= SIMILARITY).tolist():
                out.append((min(rep, self.ids[tried[k]]), max(rep, self.ids[tried[k]]), float(similarity[k])))
                old = self.comp[tried[k]]
                self.parent[int(old)] = int(comp)
                self.comp[self.comp == old] = comp
            may = np.delete(may, best)
            may = may[self.comp[may] != comp]
        self.theirs[at] = 0
        return out


def _join(batches: Iterator[pa.RecordBatch], idf: np.ndarray, agree: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_ASKED`` with texts, sorted likewise: verified links that join components."""
    now, asks, block = None, [], None
    for batch in batches:
        main, ask, told, side, rep, comp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
        sig, (data, at) = _signatures(batch.column(6)), utf8(batch.column(7))
        found: list[tuple[int, int, float]] = []
        for i, j in pieces(at):
            f, n, offsets = features(data[at[i] : at[j]], at[i : j + 1])
            w = weights(f, n, idf).astype(np.float64)
            for d in range(i, j):
                own = slice(offsets[d - i], offsets[d - i + 1])
                if (key := (main[d], ask[d], told[d])) != now:
                    now, asks, block = key, [], None
                if side[d] == 0:
                    asks.append((int(rep[d]), int(comp[d]), sig[d], f[own].copy(), w[own].copy()))
                elif asks:
                    block = block or _Block(asks)
                    found += block.ask(int(rep[d]), int(comp[d]), sig[d], f[own], w[own], agree)
        if found:
            yield _rows(found, _LINK)


def _between(members: DataFrame, reps: DataFrame, roots: DataFrame, named: DataFrame, several: DataFrame | None, idf, agree: int) -> DataFrame:
    """Links (a, b, similarity) that join components which meet in buckets."""
    placed = members.join(roots.withColumnRenamed("v", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("comp"))
    parts = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main"), F.count("*").alias("comps")).where("comps > 1").select("key", "main")
    held = written(placed.join(mixed, "key").select("main", "id", "comp").distinct().join(reps.select("id", "samples", "size"), "id"), "mixed")
    asks = F.col("comp") != F.col("main")
    sizes = held.groupBy("main").agg(F.ceil(F.sum(F.when(asks, F.col("size"))) / ASKS).cast("int").alias("asks"), F.ceil(F.count("*") / TOLD).cast("int").alias("tolds"))
    parted = held.join(sizes, "main")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    asking = parted.where(asks).select("main", part("asks").alias("ask"), every("tolds").alias("told"), F.lit(0).alias("side"), "id", "comp", "samples")
    asked = parted.select("main", every("asks").alias("ask"), part("tolds").alias("told"), F.lit(1).alias("side"), "id", "comp", "samples")
    keys = ("main", "ask", "told")
    dealt = asking.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "side")
    open_ = written(arrow(dealt, lambda it: _in_question(it, agree), _ASKED), "question")
    texts = _texts_of(named, open_.select("id").distinct(), several)
    dealt = open_.join(texts, "id").select(*_ASKED.names, "text").repartition(*keys).sortWithinPartitions(*keys, "side")
    links = written(arrow(dealt, lambda it: _join(it, idf.value, agree), _LINK), "joins")
    discard(held, open_, texts)
    return links


def _classes(rows: DataFrame, agree: int) -> DataFrame:
    """(doc_id, digest, class_id, times) by the different texts of each doc_id; rows without a doc_id are left out."""
    spark = rows.sparkSession
    ship(spark)
    named = rows.where(F.col("doc_id").isNotNull())
    idf = spark.sparkContext.broadcast(idf_table(rows))
    sampled = written(arrow(named, lambda it: _sample(it, idf.value), _SAMPLED), "samples")
    one_row = not sampled.groupBy("doc_id").count().where("count > 1").take(1)
    reps = sampled.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc"), *[F.first(c).alias(c) for c in ("samples", "bands", "size")])
    if one_row:
        reps = reps.withColumn("id", F.col("doc"))
    else:  # a doc_id names the first of its texts, hashes the others
        nth = F.row_number().over(Window.partitionBy("doc").orderBy("digest"))
        reps = reps.withColumn("id", F.when(nth == 1, F.col("doc")).otherwise(F.xxhash64("digest")))
    reps = written(reps, "texts")
    several = None if one_row else reps.select("id", "doc", "digest")
    banded = reps.select(F.explode("bands").alias("key"), "id")
    members = written(banded.join(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "members")

    pairs = _stars(members, reps.select("id", "samples"), agree)
    texts = _texts_of(named, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), several)
    links = written(_links(pairs, texts, idf), "links")
    discard(texts, pairs)
    roots = components(links.select("a", "b"))
    joins = _between(members, reps, roots, named, several, idf, agree)
    roots = components(links.unionByName(joins).select("a", "b"))

    found = reps.select("digest", "id", "doc").join(roots.withColumnRenamed("v", "id"), "id", "left").select("digest", "doc", F.coalesce("root", "id").alias("class_id"))
    if not one_row:
        least = found.groupBy("class_id").agg(F.min("doc").alias("least"))
        found = found.join(least, "class_id").select("digest", F.col("least").alias("class_id"))
    grouped = sampled.groupBy("doc_id", "digest").agg(F.count("*").alias("times")).join(found.select("digest", "class_id"), "digest", "left")
    out = written(grouped.select("doc_id", "digest", F.coalesce("class_id", "doc_id").alias("class_id"), "times"), "classes")
    idf.destroy()
    discard(sampled, reps, members, links, joins)
    return out


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", agree: int = AGREE) -> DataFrame:
    """Per row doc_id, class_id (smallest doc_id of its text's class) and kept (the class's smallest)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    one = _classes(rows, agree).select("doc_id", "class_id", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    one = one.select("doc_id", "class_id", (F.col("class_id") == F.col("doc_id")).alias("kept"))
    none = rows.where(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return one.unionByName(none)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the smallest doc_id stays.

    Rows that repeat doc_id and text (null and empty are one) stay once.
    """
    columns = [f"c{i}" for i in range(len(docs.columns))]
    own, body = (columns[docs.columns.index(c)] for c in (doc_id, text))
    rows = docs.toDF(*columns)  # columns of any name
    found = _classes(rows.select(F.col(own).cast("long").alias("doc_id"), F.col(body).alias("text")), AGREE)
    gone = written(found.where(F.col("class_id") != F.col("doc_id")).select(F.col("doc_id").alias("id"), "digest"), "gone")
    again = written(found.groupBy("doc_id").agg(F.sum("times").alias("n")).where("n > 1").select(F.col("doc_id").alias("id")), "again")
    named = rows.where(F.col(own).isNotNull()).withColumn("id", F.col(own).cast("long"))
    # only rows that may be gone or repeat are shuffled
    bloom = _bloom(gone.select("id").unionByName(again))
    some = _passing(named, "id", bloom, True)
    kept = _passing(named, "id", bloom, False).unionByName(some.join(gone.select("id").unionByName(again), "id", "left_anti").select(named.columns))
    if again.take(1):
        order = Window.partitionBy("id", F.coalesce(F.col(body), F.lit(""))).orderBy(F.col(body).asc_nulls_last(), F.xxhash64(*columns))
        several = some.join(again, "id", "left_semi").withColumn("digest", F.unhex(F.md5(body))).join(gone, ["id", "digest"], "left_anti")
        kept = kept.unionByName(several.withColumn("nth", F.row_number().over(order)).where("nth = 1").select(named.columns))
    return kept.drop("id").unionByName(rows.where(F.col(own).isNull())).toDF(*docs.columns)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
