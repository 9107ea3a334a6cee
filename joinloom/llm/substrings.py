r"""Exact substring dedup: bytes covered by a string of ``LENGTH`` bytes that also starts earlier.

Prefix doubling over sampled positions: strings of 32, then 64, then ``LENGTH`` bytes get ranks, Spark sorts (rank, position)
pairs at each length, positions whose rank is unique are dropped, and only what is left is ranked at the next length.  The
rank at 64 bytes comes of the pair of ranks at 32 at offsets 0 and 32; past the threshold nothing more is ranked.

Ranking every position of a corpus would shuffle many times its size, so 32 and 64 bytes are ranked at anchors: of the
short strings inside a string of ``LENGTH`` bytes the one with the smallest rank is its anchor (one position in 35 at 32
bytes, of those left one in 19 at 64).  Equal strings have the same anchor at the same distance, so a string whose anchor
is unique is unique.  Only starts whose anchor is left are ranked at ``LENGTH``, every one of them.

0. Documents that equal an earlier one are known by their digest: every start of theirs starts earlier.  They are
   removed whole and take part no further.
1. Anchors of 32 bytes: (rank, document, offset) sorted by rank; those of a rank that occurs at one place go.
2. Anchors of 64 bytes of the strings whose anchor of 32 bytes is left, sorted likewise.
3. Every start whose anchor of 64 bytes is left is ranked at LENGTH: by its anchor's rank, its distance to the anchor and
   its own hash.  The starts that share an anchor travel as one row, 8 bytes a start; those of an anchor at more than
   ``HOT`` places travel one by one, dealt by their rank at LENGTH.  Sorted by rank and position, the first of each rank
   in the stream is the earliest and all others are repeated.
4. Repeated starts come back to their documents as runs; covered bytes are removed.

Before each shuffle a batch is combined: of an anchor's places two are enough to tell the other batches, the others know
already; of equal starts only the earliest goes on.  So a line that a third of all documents share gives each task a few
rows.  Ranks are hashes: 64 bits of an anchor's rank and 64 of its own name a string, 64 bits of a digest a whole text.
Streams hold one batch and the ranks of one anchor of at most HOT places.  Texts travel compressed.

Null texts count as empty; a null doc_id counts as the smallest number.  Rows that share a doc_id are one document given
more than once (should their texts differ, the greatest stands for all): each gets that document's result.  Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Hashes, arrow, discard, mix, pieces, read_table, ship, small, utf8, written

LENGTH = 100
SHORT = 32
HOT = 4096
#: Bytes of a start's own hash that name it beside its anchor's rank and distance.
NAME = 8
_U = np.uint64
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_OTHER_BASE = 0x9FB21C651E98DF25


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of each run of ``width`` values, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, at: np.ndarray, length: int = LENGTH, short: int = SHORT, level: int = 1, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank at each position, smallest rank in the string from each start (0 where none counts), anchor marks.

    Strings of ``short`` bytes; at ``level`` 2 of twice that, whose rank is that of a pair.  With ``known`` ranks of the level
    before (sorted), only starts whose anchor is among them count.
    """
    n = len(data)
    at = at - at[0]
    if n < length:
        return np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, bool)
    h = Hashes(data).every(short)
    count = None
    if level == 2:
        if known is not None:
            _, least, _ = anchors(data, at, length, short)
            count = _among(known, least)
        h = mix(h[:-short] * _U(0x9E3779B97F4A7C15) + h[short:])
    width = short * level
    h = np.minimum(np.maximum(h, _U(1)), _LAST - _U(1))
    ends = np.repeat(at[1:], np.diff(at))[: len(h)]
    where = np.arange(len(h))
    h[where + width > ends] = _LAST
    span = length - width + 1
    least = _slide(h, span, np.minimum)
    least[where[: len(least)] + length > ends[: len(least)]] = 0
    if count is not None:
        least[~count] = 0
    padded = np.concatenate((np.zeros(span - 1, _U), least, np.zeros(span - 1, _U)))
    return h, least, _slide(padded, span, np.maximum) == h


def _among(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


# --- steps 1 and 2 --------------------------------------------------------------------------------------------

#: seen: the rank is known to occur at another place; the row goes to any task and is only passed on.
_ANCHOR = T.StructType([T.StructField("key", T.LongType()), T.StructField("rank", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("off", T.IntegerType()), T.StructField("seen", T.BooleanType())])
_DIGEST = T.StructType([T.StructField("doc", T.LongType()), T.StructField("digest", T.LongType())])


def _digests(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 bits of each text's digest."""
    raw, cuts = memoryview(np.ascontiguousarray(data)), at.tolist()
    return np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(cuts, cuts[1:], strict=False)), np.int64)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_digests(*utf8(batch.column(1))))], names=_DIGEST.names)


def _places(rank: np.ndarray, doc: np.ndarray, off: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``_ANCHOR`` rows of one batch: of each rank's places two go on by rank, the others are known to be repeated."""
    order = np.argsort(rank, kind="stable")
    rank, doc, off = rank[order], doc[order], off[order]
    start = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else np.zeros(0, np.int64)
    nth = np.arange(len(rank)) - np.repeat(start, np.diff(np.append(start, len(rank))))
    seen = nth > 1
    key = np.where(seen, mix(doc.view(_U) + off.astype(_U)).view(np.int64), rank)
    for k in range(0, len(rank), 50_000):
        part = slice(k, k + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (key, rank, doc, off, seen)], names=_ANCHOR.names)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of 32 bytes of texts, by digest; a task takes a text once."""
    done: set[int] = set()
    for batch in batches:
        data, at = utf8(batch.column(0))
        ids = _digests(data, at)
        fresh = np.array([not (x in done or done.add(x)) for x in ids.tolist()], bool)
        found: list[tuple[np.ndarray, ...]] = []
        for i, j in pieces(at):
            if not fresh[i:j].any():
                continue
            h, _, marks = anchors(data[at[i] : at[j]], at[i : j + 1])
            where = np.flatnonzero(marks)
            doc = i + np.searchsorted(at[i : j + 1] - at[i], where, "right") - 1
            where, doc = where[fresh[doc]], doc[fresh[doc]]
            found.append((h[where].view(np.int64), ids[doc], (where + at[i] - at[doc]).astype(np.int32)))
        if found:
            yield from _places(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _texts(whole: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows (doc, packed text, size, ...) by document, with their bytes and offsets."""
    whole = whole.take(pa.array(np.argsort(whole.column(0).to_numpy(), kind="stable")))
    bounds = np.concatenate(([0], np.cumsum(whole.column(2).to_numpy(zero_copy_only=False))))
    for lo, hi in pieces(bounds):
        batch = whole.slice(lo, hi - lo)
        data = np.frombuffer(b"".join(pa.decompress(raw.as_buffer(), size, "zstd", asbytes=True) for raw, size in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)), np.uint8)
        yield batch, data, bounds[lo : hi + 1] - bounds[lo]


def _ranks(column: pa.Array) -> np.ndarray:
    return np.unique(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(_U))


def _find_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, packed text, size, ranks at 32 bytes that repeat): anchors of 64 bytes, by document."""
    for whole in batches:
        found: list[tuple[np.ndarray, ...]] = []
        for batch, data, at in _texts(whole):
            h, _, marks = anchors(data, at, level=2, known=_ranks(batch.column(3)))
            where = np.flatnonzero(marks)
            row = np.searchsorted(at, where, "right") - 1
            found.append((h[where].view(np.int64), batch.column(0).to_numpy()[row], (where - at[row]).astype(np.int32)))
        if found:
            yield from _places(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by rank, doc and offset: those whose rank occurs at two places or more, or is known to."""
    held: pa.RecordBatch | None = None  # the last row so far
    same = False  # whether its rank has been seen at another place
    for whole in batches:
        batch = whole if held is None else pa.Table.from_batches([held, whole]).combine_chunks().to_batches()[0]
        if not len(batch):
            continue
        rank, doc, off, seen = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4))
        twin = rank[1:] == rank[:-1]
        apart = twin & ((doc[1:] != doc[:-1]) | (off[1:] != off[:-1]))
        start = np.flatnonzero(np.append(True, ~twin))
        many = np.add.reduceat(np.append(apart, False).astype(np.int64) + seen, start) > 0
        many[0] |= same
        keep = np.repeat(many, np.diff(np.append(start, len(rank))))
        same = bool(many[-1])
        held = batch.slice(len(batch) - 1)
        # rows of the last rank before its second place is seen are held back by their text: one place, one row
        keep[-1] = False
        if keep.any():
            yield batch.filter(pa.array(keep))
    if held is not None and same:
        yield held


def _left(found: DataFrame, name: str) -> DataFrame:
    """The anchors whose rank occurs at several places, as a table (rank, doc)."""
    sorted_ = found.repartition("key").sortWithinPartitions("rank", "doc", "off")
    return written(arrow(sorted_, _repeated, _ANCHOR).select("rank", "doc"), name)


# --- step 3 ---------------------------------------------------------------------------------------------------

#: before: distance from the first start to the anchor; below 0, a run of so many starts that are known to be repeated.
_RANKED = T.StructType([T.StructField("rank", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("off", T.IntegerType()), T.StructField("before", T.IntegerType()), T.StructField("names", T.BinaryType())])
_RUN = T.StructType([T.StructField("doc", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def _runs_of(row: np.ndarray, start: np.ndarray, apart: np.ndarray | None = None) -> np.ndarray:
    """Where runs of successive starts of one row begin, and the end; ``apart`` cuts them further."""
    new = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    return np.append(np.flatnonzero(np.append(True, new if apart is None else new | apart)), len(start))


def _rank(batches: Iterator[pa.RecordBatch], length: int = LENGTH, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows (doc, packed text, size, ranks at 64 bytes that repeat, those of many places): the starts with such an anchor."""
    for whole in batches:
        held: list[tuple[np.ndarray, ...]] = []
        for batch, data, at in _texts(whole):
            known, hot = _ranks(batch.column(3)), _ranks(batch.column(4))
            h, least, marks = anchors(data, at, length, level=2)
            if not len(least) or not len(known):
                continue
            starts = np.flatnonzero(_among(known, least))
            if not len(starts):
                continue
            # the leftmost position that holds the least rank: the next one from the start on
            where = np.flatnonzero(marks)
            group, own = np.searchsorted(known, least[starts]), np.searchsorted(known, h[where])
            own[_among(known, h[where]) == 0] = len(known)
            places = np.sort(own * len(data) + where)
            anchor = places[np.searchsorted(places, group * len(data) + starts)] % len(data)
            names = Hashes(data, _OTHER_BASE).every(length)[starts]
            row = np.searchsorted(at, starts, "right") - 1
            held.append((h[anchor], batch.column(0).to_numpy()[row], (starts - at[row]).astype(np.int32), (anchor - starts).astype(np.int32), names, _among(hot, h[anchor])))
            if sum(len(x[0]) for x in held) >= most:
                yield from _combined(held)
                held = []
        if held:
            yield from _combined(held)


def _combined(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """``_RANKED`` rows of starts in order: the earliest of equal ones go on, the others are known to be repeated."""
    rank, doc, off, before, names, hot = (np.concatenate(x) for x in zip(*held, strict=True))
    key = mix(rank * _U(0x9E3779B97F4A7C15) + before.astype(_U)) ^ mix(names + _U(1))
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    again = np.flatnonzero(~first)
    if len(again):  # runs, dealt by anything
        cut = _runs_of(doc[again], off[again].astype(np.int64))
        begin = again[cut[:-1]]
        deal = mix(doc[begin].view(_U) + off[begin].astype(_U)).view(np.int64)
        yield _ranked(deal, doc[begin], off[begin], -np.diff(cut).astype(np.int32), np.zeros(0, _U), np.zeros(len(begin) + 1, np.int32))
    few, many = np.flatnonzero(first & ~hot), np.flatnonzero(first & hot)
    if len(few):
        anchor = off[few].astype(np.int64) + before[few]
        cut = _runs_of(doc[few], off[few].astype(np.int64), anchor[1:] != anchor[:-1])
        begin = few[cut[:-1]]
        yield _ranked(rank[begin].view(np.int64), doc[begin], off[begin], before[begin], names[few], cut * NAME)
    if len(many):
        yield _ranked(key[many].view(np.int64), doc[many], off[many], before[many], names[many], np.arange(len(many) + 1) * NAME)


def _ranked(rank: np.ndarray, doc: np.ndarray, off: np.ndarray, before: np.ndarray, names: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    raw = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(names).astype("<u8"))])
    return pa.RecordBatch.from_arrays([pa.array(rank), pa.array(doc), pa.array(off), pa.array(before), raw], names=_RANKED.names)


def _later(batches: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """Rows sorted by rank, document and start: runs of bytes of starts that aren't the first of their rank."""

    def runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=_RUN.names)

    last, seen = None, np.zeros(0, _U)
    for whole in batches:
        for lo in range(0, len(whole), 5000):
            batch = whole.slice(lo, 5000)
            rank = batch.column(0).to_numpy().view(_U)
            doc, off, before = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            known = before < 0
            if known.any():
                yield runs(doc[known], off[known], off[known].astype(np.int64) - before[known] - 1 + length)
                batch = batch.filter(pa.array(~known))
                rank, doc, off, before = rank[~known], doc[~known], off[~known], before[~known]
            if not len(batch):
                continue
            names, ends = utf8_binary(batch.column(4))
            size = np.diff(ends) // NAME
            own = (names.reshape(-1, NAME).astype(_U) << (np.arange(NAME, dtype=_U) * _U(8))).sum(1, dtype=_U)
            row = np.repeat(np.arange(len(rank)), size)
            step = np.arange(len(own)) - np.repeat(ends[:-1] // NAME, size)
            key = mix(rank[row] * _U(0x9E3779B97F4A7C15) + (before[row] - step).astype(_U)) ^ mix(own + _U(1))
            # starts of one anchor ascend with the rows, but rows of one document may interleave distances: order by (key, doc, start)
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            later = np.zeros(len(key), bool)
            later[order[1:]] = sorted_key[1:] == sorted_key[:-1]
            if last is not None and len(rank) and rank[0] == last:
                head = int(size[rank == last].sum())
                later[:head] |= np.isin(key[:head], seen)
            if len(rank):
                tail = key[len(key) - int(size[rank == rank[-1]].sum()) :]
                seen = np.unique(tail if rank[-1] != last else np.concatenate((seen, tail)))
                last = rank[-1]
            hit = np.flatnonzero(later)
            if len(hit):
                start = off[row[hit]].astype(np.int64) + step[hit]
                cut = np.flatnonzero(np.append(True, (row[hit][1:] != row[hit][:-1]) | (start[1:] != start[:-1] + 1)))
                end = start[np.append(cut[1:], len(hit)) - 1] + length
                yield runs(doc[row[hit[cut]]], start[cut], end)


def utf8_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8), at - at[0]


# --- step 4 ---------------------------------------------------------------------------------------------------


def union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
    T.StructField("kept_sha256", T.StringType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column(1))
        raw, cuts = memoryview(np.ascontiguousarray(data)), at.tolist()
        packed = [pa.compress(raw[a:b], "zstd", asbytes=True) for a, b in zip(cuts, cuts[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(np.diff(at))], names=_PACKED.names)


_PACKED = T.StructType([T.StructField("doc", T.LongType()), T.StructField("packed", T.BinaryType()), T.StructField("size", T.LongType())])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, packed, size, runs): what is left of each document."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_RESULT)
    for whole in batches:
        for lo in range(0, len(whole), 500):
            batch = whole.slice(lo, 500)
            rows = []
            for doc, raw, size, runs, copy in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                data = pa.decompress(raw.as_buffer(), size, "zstd", asbytes=True)
                gone = [(0, size)] if copy and size >= LENGTH else union([(r["start"], r["end"]) for r in runs or ()])
                kept, at = hashlib.sha256(), 0
                for a, b in gone:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                rows.append((doc, size, sum(b - a for a, b in gone), len(gone), kept.hexdigest(), [{"start": a, "end": b} for a, b in gone]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``removed`` (byte spans)."""
    spark = docs.sparkSession
    ship(spark)
    smallest = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(smallest)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    times = written(rows.groupBy("doc").agg(F.count("*").alias("times")).where("times > 1"), "times")
    several = bool(times.take(1))
    if several:
        rows = rows.join(times, "doc", "left_anti").unionByName(rows.join(times, "doc", "left_semi").groupBy("doc").agg(F.max("text").alias("text")))
    digests = written(arrow(rows, _digest, _DIGEST), "digests")
    first = written(digests.groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("n")), "firsts")
    copies = digests.join(first.where("n > 1"), "digest").where(F.col("doc") != F.col("first")).select("doc", F.lit(True).alias("copy"))
    left_32 = _left(arrow(rows.select("text"), _find, _ANCHOR), "anchors-32")
    ranks = left_32.groupBy("doc").agg(F.collect_set("rank").alias("ranks")).withColumnRenamed("doc", "digest")
    # only the first document of each digest goes on
    ranks_32 = written(ranks.join(first, "digest").select(F.col("first").alias("doc"), "ranks"), "ranks-32")
    packed = arrow(rows, _pack, _PACKED)
    left_64 = _left(arrow(packed.join(ranks_32, "doc").select("doc", "packed", "size", "ranks"), _find_again, _ANCHOR), "anchors-64")
    hot = written(left_64.groupBy("rank").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("rank", F.col("rank").alias("hot")), "hot")
    ranks_64 = written(left_64.join(small(hot), "rank", "left").groupBy("doc").agg(F.collect_set("rank").alias("ranks"), F.collect_set("hot").alias("hot")), "ranks-64")
    ranked = arrow(packed.join(ranks_64, "doc").select("doc", "packed", "size", "ranks", "hot"), _rank, _RANKED)
    later = arrow(ranked.repartition("rank").sortWithinPartitions("rank", "doc", "off"), _later, _RUN)
    runs = later.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    fate = written(runs.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("runs", F.lit(None).cast(runs.schema["runs"].dataType)).select("doc", "runs", "copy")), "runs")
    discard(digests, first, left_32, ranks_32, left_64, hot, ranks_64)
    result = arrow(packed.join(fate, "doc", "left").select("doc", "packed", "size", "runs", "copy"), _remove, _RESULT)
    if several:
        result = result.join(times.withColumnRenamed("doc", "doc_id"), "doc_id", "left").withColumn("again", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)).cast("int")))).drop("again", "times")
    return result.withColumn("doc_id", F.when(F.col("doc_id") != smallest, F.col("doc_id")))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
