r"""Mixing sources to target weights by cube-method balanced sampling.

Sizes are numbers of words.  Sources in code-point order (null last) weigh 1, 2, 3 repeating and share all words;
no source gets more than ``MOST`` times its size, the excess is shared again by weight.  Targets are the water level of
that: with ratio cap / weight ascending, the first sources are capped and the rest take weight times the level.

A source with ratio r = target / size takes every document floor(r) times and a balanced sample with inclusion
probability p = r - floor(r).  The cube method moves the probabilities within the null space of the balancing
constraints (tokens and documents): of three undecided documents of sizes a, b, c the direction (b - c, c - a, a - b)
keeps both totals, and a random one of the two steps along it that decide a document keeps the expectation.  A flight
in a block of about ``BLOCK`` documents leaves at most two undecided.  Those of many blocks, with the ``OPEN`` smallest
of each, which its flight leaves alone, form blocks of the next level, until each source has one block.  Blocks are dealt
by source and block, so a source with a third of all rows merely has more blocks and no task gets more than its share.

The landing rounds the last two of a source and so misses its total by up to half a document.  It then exchanges
documents that the last flight decided, one taken for one left out, or lets a single one change, as long as that brings
the total nearer: a source ends within about its smallest document of its target, wherever its documents allow that.

Units are (doc_id, source), for null ids with the text's hash: rows that share them are taken equally often.  Null texts
have size 0; documents of sources without words are not taken.  Draws come from a hash of the unit, so reruns agree.
Sources are ranked by a range sort and the water level is found by sums over them, so their number isn't bounded either.
Extra columns pass through ``mix``, whatever their names, and are ignored by ``plan``.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, read_table, ship, small, written

MOST = 3
WEIGHTS = (1, 2, 3)
BLOCK = 2000
OPEN = 16
WORD = r"[^\x20\x09-\x0D]+"
_STATE = "s long, block long, uid long, unit string, size long, x double, open boolean"


def flight(size: np.ndarray, x: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities after the flight: all but at most two are 0 or 1; the sums of x and size * x stay."""
    rng = np.random.default_rng(seed)
    draws = rng.random(max(1, len(x)))
    x = x.astype(float).copy()
    open_ = [i for i in np.flatnonzero((x > 0) & (x < 1)).tolist()][::-1]
    values, sizes, k = x.tolist(), size.tolist(), 0
    hand: list[int] = []
    while True:
        while len(hand) < 3 and open_:
            hand.append(open_.pop())
        if len(hand) < 3:
            break
        a, b, c = (sizes[i] for i in hand)
        u = (float(b - c), float(c - a), float(a - b))
        if not any(u):  # equal sizes: any direction of sum 0 will do
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for i, d in zip(hand, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - values[i]) / d), min(down, values[i] / d)
            elif d < 0:
                up, down = min(up, values[i] / -d), min(down, (1 - values[i]) / -d)
        go = up if draws[k % len(draws)] * (up + down) < down else -down
        k += 1
        left, nearest = [], min(range(3), key=lambda j: min(values[hand[j]] + go * u[j], 1 - values[hand[j]] - go * u[j]) if u[j] else 2.0)
        for j, i in enumerate(hand):
            v = min(1.0, max(0.0, values[i] + go * u[j]))
            if j == nearest or v < 1e-12 or v > 1 - 1e-12:
                v = float(round(v))
            else:
                left.append(i)
            values[i] = v
        hand = left
    return np.array(values)


def landing(size: np.ndarray, x: np.ndarray, free: np.ndarray | None = None) -> np.ndarray:
    """The undecided ones (two at most after a flight) rounded so that sum(size * x) changes least.

    Then documents that are ``free`` (by default those undecided) change as long as that brings the sum nearer to what it
    was: a taken one for one left out, which keeps their number, or else a single one.
    """
    x, size = x.astype(float).copy(), size.astype(float)
    open_ = np.flatnonzero((x > 0) & (x < 1))
    free = np.isin(np.arange(len(x)), open_) if free is None else free
    want, number = float((size * x).sum()), float(x[open_].sum())
    masks = [[m >> j & 1 for j in range(len(open_))] for m in range(1 << len(open_))]
    x[open_] = min(masks, key=lambda m: (abs(float(size[open_] @ m) - float(size[open_] @ x[open_])), abs(sum(m) - number), m))
    error = want - float((size * x).sum())
    while abs(error) > 1e-6:
        best: tuple = (abs(error) - 1e-6, -1, -1)
        taken, out = (np.flatnonzero(free & (x == v)) for v in (1, 0))
        taken = taken[np.argsort(size[taken], kind="stable")]
        if len(taken) and len(out):  # for each left out, the taken one whose exchange comes nearest
            at = np.searchsorted(size[taken], size[out] - error)
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(taken) - 1)):
                miss = np.abs(error - size[out] + size[taken[near]])
                k = int(miss.argmin())
                best = min(best, (float(miss[k]), int(out[k]), int(taken[near[k]])))
        for some, sign in ((out, 1.0), (taken, -1.0)):
            if len(some):
                miss = np.abs(error - sign * size[some])
                k = int(miss.argmin())
                if miss[k] < best[0] - 1e-6:
                    best = (float(miss[k]), int(some[k]), -1)
        if best[1] < 0:
            break
        for k in best[1:]:
            if k >= 0:
                x[k] = 1 - x[k]
        error = want - float((size * x).sum())
    return x


def _fly(pdf: pd.DataFrame) -> pd.DataFrame:
    return _decide(pdf, False)


def _land(pdf: pd.DataFrame) -> pd.DataFrame:
    return _decide(pdf, True)


def _decide(pdf: pd.DataFrame, last: bool) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "uid", "unit"], ascending=[False, True, True], kind="stable").reset_index(drop=True)  # small ones last
    size, x = pdf["size"].to_numpy(), pdf["x"].to_numpy()
    fly = len(x) if last else max(0, len(x) - OPEN)  # the smallest wait for the last level
    seed = (int(pdf["s"].iat[0]) * 1_000_003 + int(pdf["block"].iat[0])) & 0xFFFFFFFF
    after = np.concatenate((flight(size[:fly], x[:fly], seed), x[fly:]))
    pdf["x"] = landing(size, after, np.ones(len(x), bool)) if last else after
    pdf["open"] = (pdf["x"] > 0) & (pdf["x"] < 1)
    return pdf


def targets(sizes: DataFrame) -> DataFrame:
    """Per source (columns source, source_size) its weight, number ``s`` and target."""
    # numbers in code-point order: sorted in ranges, counted by range, numbered within each
    ranged = written(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "mix-ranges")
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    before = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    ranked = ranged.withColumn("nth", nth).join(before, "range").withColumn("s", (F.col("before") + F.col("nth")).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("s") - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = written(ranked.select("source", "source_size", "s", weight.alias("weight"), (MOST * F.col("source_size")).alias("cap")), "mix-ranks")
    # the water level: more sources reach their cap each time, until none does
    level, capped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("cap") < level * F.col("weight")
        n, whole, caps, free = ranked.agg(F.count_if(over), F.sum("source_size"), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, level = n, (whole - (caps or 0)) / free
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("cap").cast("double"), F.lit(level).cast("double") * F.col("weight")))
    return ranked.select("source", "source_size", "s", "weight", target.alias("target"))


def _unit(doc_id: str, source: str, text: str) -> list:
    """Columns doc_id, source and ``key``, which tells rows without an id apart."""
    key = F.when(F.col(doc_id).isNull(), F.xxhash64(text)).otherwise(F.lit(0))
    return [F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), key.alias("key")]


def _same(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.key") == F.col(f"{b}.key"))


def plan(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Per row doc_id, source, key, size, source_size, target, copies and taken."""
    ship(docs.sparkSession)
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    rows = written(docs.select(*_unit(doc_id, source, text), size.alias("size")), "mix-sizes")
    sources = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    units = rows.groupBy("doc_id", "source", "key").agg(F.sum("size").alias("size"))
    # one row a source: broadcast if they are few; else adaptive execution splits hot sources
    units = units.alias("u").join(small(sources).alias("t"), F.col("u.source").eqNullSafe(F.col("t.source"))).select("u.doc_id", "u.source", "u.key", "u.size", "t.s", "t.source_size", "t.target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    unit = F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "key")
    units = units.withColumn("whole", F.floor(ratio)).withColumn("x", ratio - F.floor(ratio)).withColumn("uid", F.xxhash64("doc_id", "s", "key")).withColumn("unit", unit)
    units = written(units, "mix-units")
    undecided = (F.col("x") > 0) & (F.col("x") < 1)
    counts = written(units.where(undecided).groupBy("s").agg(F.count("*").alias("n")), "mix-counts")
    state = units.where(undecided).join(small(counts), "s").withColumn("block", F.pmod("uid", F.ceil(F.col("n") / BLOCK))).select("s", "block", "uid", "unit", "size", "x")
    blocks = -(-(counts.agg(F.max("n")).first()[0] or 0) // BLOCK)
    together, decided, flights = max(2, BLOCK // (OPEN + 2)), [], []
    while True:
        last = blocks <= 1
        # a join by source has dealt the rows by source alone; blocks of one source go to different tasks
        flown = written(state.repartition("s", "block").groupBy("s", "block").applyInPandas(_land if last else _fly, _STATE), "mix-flight")
        flights.append(flown)
        decided.append(flown.where("NOT open"))
        if last:
            break
        blocks = -(-blocks // together)
        state = flown.where("open").withColumn("block", F.floor(F.col("block") / together)).drop("open")
    chosen = functools.reduce(DataFrame.unionByName, decided).select("s", "uid", "unit", F.col("x").cast("long").alias("chosen"))
    copies = F.col("whole") + F.coalesce("chosen", F.lit(0))
    taken = written(units.join(chosen, ["s", "uid", "unit"], "left").select("doc_id", "source", "key", "source_size", "target", copies.alias("copies")), "mix-taken")
    discard(units, sources, counts, *flights)
    out = rows.alias("r").join(taken.alias("t"), _same("r", "t"))
    return out.select("r.doc_id", "r.source", "r.key", "r.size", "t.source_size", "t.target", "t.copies", (F.col("t.copies") * F.col("r.size")).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes it."""
    copies = plan(docs, doc_id, source, text).where(F.col("copies") > 0).groupBy("doc_id", "source", "key").agg(F.max("copies").alias("copies"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_unit(doc_id, source, text))  # columns of any name
    rows = whole.alias("d").join(copies.alias("c"), _same("d", "c")).select("d.row", F.explode(F.sequence(F.lit(1), F.col("c.copies").cast("int"))))
    return rows.select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken")
