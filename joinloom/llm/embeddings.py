"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations.

1. Vectors that are null, zero or hold null or non-finite components link with nothing; of identical vectors one
   stands for all, so a group of copies costs one vector.
2. A vector is padded to a power of two and rotated by three rounds of random signs and a Walsh-Hadamard transform,
   ``ROTATIONS`` times independently, and the first ``KEPT`` coordinates are kept: a random projection, so that buckets and
   recall don't depend on the dimension.  The nearest vertex of the cross-polytope (largest coordinate and its sign) of
   each rotation makes up its home bucket.  ``PROBES`` buckets, those with the least loss, are probed.  Pairs at a cosine
   of exactly 0.9 meet with a probability of about 0.94, closer ones more often.
3. Each vector is indexed in its home and asks in all its probes, so an ordered pair meets at most once.  A pair
   counts for both if either probes the other's home: where x meets q but q wouldn't have met x, the indexed side is
   credited.
4. First only ids travel, with their buckets and ``BITS`` signs of further rotations: an index row to its home's first
   vertex and one row to each first vertex among a vector's probes.  Which vectors are in question at all (those that meet
   one with at most as many different signs as four standard deviations beyond the threshold's mean, which loses about
   3 in 100,000 links at the threshold) comes out, one row a vector and vertex.
5. Those vectors are fetched and every pair of them that meets is verified by the exact cosine in double precision.
   Vertices are cut into chunks of about ``CHUNK`` indexed vectors by hash, and queries go to every chunk, so no task
   holds more than a chunk and a batch of queries, whatever a bucket's size.  A chunk returns counts and a spanning
   forest of its links, never the pairs.  Nothing is capped.

The counts behind the chunks are at most 2 * KEPT numbers, aggregated in Spark.  A shorter vector
counts as padded with zeros.  A null vec_id links with nothing.  Repeated rows are vectors each and link with each
other.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow, discard, read_table, ship, written
from .components import components

ROTATIONS = 2
KEPT = 64
PROBES = 32
TOP = 16
BITS = 128
CHUNK = 2048
THRESHOLD = 0.9

_HASHED = T.StructType([
    T.StructField("cid", T.LongType()), T.StructField("n", T.LongType()), T.StructField("v", T.ArrayType(T.FloatType())),
    T.StructField("probes", T.ArrayType(T.LongType())), T.StructField("signs", T.BinaryType()),
])
#: side 0: indexed in bucket ``codes[0]``; 1: asks in ``codes``, all of this vertex.
_MET = T.StructType([
    T.StructField("vertex", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("side", T.IntegerType()), T.StructField("cid", T.LongType()),
    T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("signs", T.BinaryType()),
])
_OPEN = T.StructType([T.StructField("vertex", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("side", T.IntegerType()), T.StructField("cid", T.LongType())])
_FOUND = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("links", T.LongType())])


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows, orthonormal."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def _rotated(unit: np.ndarray, width: int, rng: np.random.Generator) -> np.ndarray:
    y = np.zeros((len(unit), width))
    y[:, : unit.shape[1]] = unit
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], width))
    return y


def _width(d: int) -> int:
    return 1 << max(1, (d - 1).bit_length())


def vertices(d: int) -> int:
    """The vertices of the cross-polytope for vectors of ``d`` components."""
    return 2 * min(_width(d), KEPT)


def hashes(unit: np.ndarray, rotations: int = ROTATIONS, probes: int = PROBES, seed: int = 7) -> np.ndarray:
    """The buckets that each row probes, its home first."""
    n, d = unit.shape
    kept, rng = vertices(d) // 2, np.random.default_rng(seed)
    code, loss = np.zeros((n, 1), np.int64), np.zeros((n, 1))
    for _ in range(rotations):
        y = _rotated(unit, _width(d), rng)[:, :kept]
        both = np.concatenate((y, -y), 1)
        top = np.argsort(-both, 1, kind="stable")[:, :TOP]
        value = np.take_along_axis(both, top, 1)
        code = (code[:, :, None] * (2 * kept) + top[:, None, :]).reshape(n, -1)
        loss = (loss[:, :, None] + ((value[:, :1] - value) ** 2)[:, None, :]).reshape(n, -1)
    order = np.argsort(loss, 1, kind="stable")[:, :probes]
    return np.take_along_axis(code, order, 1)


def signs(unit: np.ndarray, seed: int = 8) -> np.ndarray:
    """Rows of BITS signs of rotated coordinates, packed to 64-bit numbers."""
    width, rng = _width(unit.shape[1]), np.random.default_rng(seed)
    y = np.concatenate([_rotated(unit, width, rng) for _ in range(-(-BITS // width))], 1)[:, :BITS]
    return np.packbits(y > 0, axis=1).view(np.uint64)


def most_apart(threshold: float) -> int:
    """As many different signs as hardly any pair of this cosine has."""
    p = math.acos(threshold) / math.pi
    return int(BITS * p + 4 * math.sqrt(BITS * p * (1 - p))) + 1


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.float32)
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(column)), lengths), at] = values
    return out


def _units(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # squares of the smallest and largest floats stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hash(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (cid, n, v) with their buckets and signs."""
    from pyspark.sql.pandas.types import to_arrow_schema

    for whole in batches:
        for i in range(0, len(whole), 1000):
            batch = whole.slice(i, 1000)
            unit = _units(_matrix(batch.column(2), width))
            probes = hashes(unit)
            n, p = probes.shape
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * p + 1, p), pa.int32()), pa.array(probes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array([x.tobytes() for x in signs(unit)], pa.binary())], schema=to_arrow_schema(_HASHED))


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _in_question(batches: Iterator[pa.RecordBatch], apart: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of ``_MET`` sorted by vertex, chunk and side: which meet one of the other side that few signs tell from it."""
    now, held, block, hit = None, [], None, None

    def close() -> Iterator[pa.RecordBatch]:
        if hit is not None and hit.any():
            yield block[0].filter(pa.array(hit))

    for whole in batches:
        if not len(whole):
            continue
        columns = [whole.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        edge = (np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1).tolist()
        for s, e in zip([0, *edge], [*edge, len(whole)], strict=True):
            key = (columns[0][s], columns[1][s])
            if key != now:
                yield from close()
                now, held, block, hit = key, [], None, None
            if columns[2][s] == 0:
                held.append(whole.slice(s, e - s))
                continue
            if not held:
                continue
            if block is None:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                home = rows.column(4).flatten().to_numpy()
                order = np.argsort(home, kind="stable")
                rows = rows.take(pa.array(order))
                block = (rows.select(_OPEN.names), home[order], rows.column(3).to_numpy(), _signs(rows.column(5)))
                hit = np.zeros(len(rows), bool)
            asks = whole.slice(s, e - s)
            mine, own = asks.column(3).to_numpy(), _signs(asks.column(5))
            codes = asks.column(4).flatten().to_numpy()
            who = np.repeat(np.arange(len(asks)), pc.list_value_length(asks.column(4)).to_numpy())
            low, high = (np.searchsorted(block[1], codes, side) for side in ("left", "right"))
            upto, told = np.concatenate(([0], np.cumsum(high - low))), np.zeros(len(asks), bool)
            i = 0
            while i < len(codes):  # some codes at a time, so that about ``most`` pairs are looked at
                j = max(i + 1, int(np.searchsorted(upto, upto[i] + most, "right")) - 1)
                size = high[i:j] - low[i:j]
                x = np.arange(size.sum()) + np.repeat(low[i:j] - (np.cumsum(size) - size), size)
                q = np.repeat(who[i:j], size)
                near = np.bitwise_count(own[q] ^ block[3][x]).sum(1, dtype=np.int64) <= apart
                near &= mine[q] != block[2][x]
                told[q[near]] = True
                hit[x[near]] = True
                i = j
            if told.any():
                yield asks.select(_OPEN.names).filter(pa.array(told))
    yield from close()


class _Chunk:
    """The indexed vectors of one chunk, and what queries have found so far."""

    def __init__(self, key: tuple, apart: int):
        self.key, self.apart, self.parts = key, apart, []
        self.ready = False

    def add(self, *rows: np.ndarray) -> None:
        self.parts.append(rows)

    def close(self) -> None:
        if not self.ready and self.parts:
            self.cid, self.n, self.probes, self.signs, self.unit = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            self.homes, self.which = np.unique(self.probes[:, 0], return_inverse=True)
            self.credit = np.zeros(len(self.cid), np.int64)
            self.label = np.arange(len(self.cid))
        self.ready = True

    def ask(self, cid, n, probes, own, unit, threshold: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Counts of the queries, and edges that hold together what they link."""
        self.close()
        if not self.parts:
            return []
        linked = (unit @ self.unit.T >= threshold) & (cid[:, None] != self.cid[None, :])
        asks = np.flatnonzero(linked.any(1))
        if not len(asks):
            return []
        linked, cid, n, probes, own = linked[asks], cid[asks], n[asks], probes[asks], own[asks]
        linked &= np.stack([(probes == h).any(1) for h in self.homes], 1)[:, self.which]
        q, x = np.nonzero(linked)
        linked[q, x] = np.bitwise_count(own[q] ^ self.signs[x]).sum(1, dtype=np.int64) <= self.apart
        homes, which = np.unique(probes[:, 0], return_inverse=True)
        met = np.stack([(self.probes == h).any(1) for h in homes])
        self.credit += n @ (linked & ~met[which]).astype(np.int64)
        some = linked.any(1)
        linked, cid = linked[some], cid[some]
        if not len(cid):
            return []
        a, b = [cid], [self.cid[linked.argmax(1)]]
        for row in linked:  # what one query links is one component; edges only where labels meet
            found = np.flatnonzero(row)
            labels = self.label[found]
            if labels[0] != labels.min() or labels.max() != labels.min():
                low = labels.min()
                for other in np.unique(labels):
                    if other != low:
                        a.append(self.cid[[other]])
                        b.append(self.cid[[low]])
                        self.label[self.label == other] = low
        links = linked.astype(np.int64) @ self.n
        zero = np.zeros(sum(map(len, a[1:])), np.int64)
        return [(np.concatenate(a), np.concatenate(b), np.concatenate((links, zero)))]

    def credits(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if not self.ready or not self.parts:
            return []
        some = np.flatnonzero(self.credit)
        return [(self.cid[some], self.cid[some], self.credit[some])] if len(some) else []


def _verify(batches: Iterator[pa.RecordBatch], width: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (vertex, chunk, side, cid, n, v, probes, signs) sorted by vertex, chunk and side."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, apart = to_arrow_schema(_FOUND), most_apart(threshold)
    now: _Chunk | None = None

    def out(found) -> list[pa.RecordBatch]:
        return [pa.RecordBatch.from_arrays([pa.array(x) for x in row], schema=schema) for row in found]

    for whole in batches:
        for i in range(0, len(whole), 1000):
            batch = whole.slice(i, 1000)
            vertex, chunk, side, cid, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            unit = _units(_matrix(batch.column(5), width))
            probes, own = batch.column(6).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1), _signs(batch.column(7))
            edge = np.flatnonzero(np.append(True, (vertex[1:] != vertex[:-1]) | (chunk[1:] != chunk[:-1]) | (side[1:] != side[:-1])))
            for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(batch)], strict=True):
                key, rows = (vertex[s], chunk[s]), tuple(x[s:e] for x in (cid, n, probes, own, unit))
                if now is None or now.key != key:
                    if now is not None:
                        yield from out(now.credits())
                    now = _Chunk(key, apart)
                if side[s] == 0:
                    now.add(*rows)
                else:
                    yield from out(now.ask(*rows, threshold))
    if now is not None:
        yield from out(now.credits())


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """Per row vec_id, n_links, component_id and kept."""
    spark = rows.sparkSession
    ship(spark)
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>").alias("v"))
    fine = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = rows.where(fine)
    width = good.agg(F.max(F.size("v"))).first()[0]
    alone = rows.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if not width:
        return alone
    good = good.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast("float")))  # no negative zeros
    classes = written(good.groupBy("v").agg(F.min("vec_id").alias("cid"), F.count("*").alias("n")), "vectors")
    hashed = written(arrow(classes.select("cid", "n", "v"), lambda it: _hash(it, width), _HASHED), "hashed")
    corners, apart = vertices(width), most_apart(threshold)
    of = lambda c: F.floor(c / corners ** (ROTATIONS - 1))
    index = hashed.select(of(F.get("probes", F.lit(0))).alias("vertex"), F.lit(0).alias("side"), "cid", F.slice("probes", 1, 1).alias("codes"), "signs")
    split = F.transform(F.array_distinct(F.transform("probes", of)), lambda x: F.struct(x.alias("vertex"), F.filter("probes", lambda c: of(c) == x).alias("codes")))
    asks = hashed.select(F.explode(split).alias("x"), "cid", "signs").select("x.vertex", F.lit(1).alias("side"), "cid", "x.codes", "signs")
    sizes = index.groupBy("vertex").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    spread = F.when(F.col("side") == 0, F.array(F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    met = index.unionByName(asks).join(sizes, "vertex").withColumn("chunk", F.explode(spread)).select(*_MET.names)
    keys = ("vertex", "chunk")
    open_ = written(arrow(met.repartition(*keys).sortWithinPartitions(*keys, "side"), lambda it: _in_question(it, apart), _OPEN), "vectors-in-question")
    fetched = open_.join(hashed, "cid").select(*_OPEN.names, "n", "v", "probes", "signs").repartition(*keys).sortWithinPartitions(*keys, "side")
    found = written(arrow(fetched, lambda it: _verify(it, width, threshold), _FOUND).groupBy("a", "b").agg(F.sum("links").alias("links")), "vector-links")
    discard(hashed, open_)
    roots = components(found.select("a", "b"))
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    nodes = classes.join(links.withColumnRenamed("a", "cid"), "cid", "left").join(roots.withColumnRenamed("v", "cid"), "cid", "left")
    nodes = written(nodes.select("v", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cid").alias("component_id")), "vector-classes")
    linked = good.join(nodes, "v").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(alone)


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
