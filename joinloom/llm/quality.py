r"""Quality rules: base counts and robust multivariate outliers, in DataFrame functions only.

Base counts of whole texts (words are ``[^\x20\x09-\x0D]+``) come from one expression per row: the array of words is
bound once by a lambda, three-word windows are compared by hash first, and only texts in which two hashes agree sort
their windows, by the words themselves, so the count is exact.

The method fits a minimum-covariance-determinant estimate for each language and source, and for each language, to the
transformed vector (log mean word length, roots of the shares of symbols, duplicate lines, repeated words and capitals).
It has three deterministic starts: medians and median absolute deviations; these with the correlations of the hyperbolic
tangents of the standardised statistics; and with those of their spatial signs.  From each, concentration steps take the
distances under the last estimate, their ``SUBSET`` quantile in each group and the mean and covariance of the documents
below it, until the determinant falls no further; after ``TRIED`` steps only the start with the smallest determinant goes on.
Documents tied at the quantile share the weight that is left, so a group of copies never takes the subset beyond its
half.  Last, the estimate is reweighted: mean and covariance of all documents within ``INNER``, as the half alone is
narrow.  Up to nearly half of a group may be outliers.  ``FLOOR`` is added to the standard deviations: a statistic that
is zero for nearly all documents of a group would make the covariance singular.

A group's estimate is drawn towards its language's by the weight n / (n + ``SHRINK``), so a source of few documents is
judged mostly by its language, one of many by itself, and nothing depends on a least size.  The limit on the squared
distance is ``CUTOFF`` * (1 + (``FEW`` / n)^2) for n documents of the language: a handful of documents reject nothing.

Estimates are small tables written to the shared folder between steps.  Those of at most ``SMALL_ROWS`` rows, which
are counted, are broadcast; larger ones are joined by Spark's own choice.  Documents never move except as rows of a dozen
numbers, and aggregates are partial before they shuffle, so a source with a third of all rows is no harder than any other.

A null or empty text has no words, fails the base rules and is not kept.  Null languages and sources are groups
like others.  Repeated rows count each for itself.  Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small, written

STATS = ("length", "symbols", "lines", "repeats", "capitals")
FLOOR = (0.08, 0.05, 0.20, 0.20, 0.08)
SUBSET = 0.5
#: Makes the covariance of the SUBSET of least distances that of the whole, for five normal dimensions: SUBSET / P(chi2(7) <= q), q = chi2(5)'s SUBSET quantile.
CONSISTENT = 0.5 / 0.26148
#: The 0.975 quantile of chi-squared with five degrees of freedom, and the factor for the covariance within it.
INNER = 12.8325
INNER_CONSISTENT = 0.975 / 0.92370
#: A step that lowers the logarithm of the determinant by less ends a start.
LEAST_FALL = 1e-2
#: Steps that all starts take before only the best one goes on.
TRIED = 2
SHRINK, FEW = 40, 20
#: The 0.99999 quantile of chi-squared with five degrees of freedom.
CUTOFF = 30.86
SYMBOLS = "[#*$%&|<>]"
SPACE = r"[\x20\x09-\x0D]+"


def _repeat_words(w: Column) -> Column:
    """Words of ``w`` (an array bound by a lambda) inside three-word windows found twice or more."""
    n = F.size(w)
    hashes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(n - 2, F.lit(0)))

    def count(p: Column) -> Column:
        twice = F.transform(p, lambda x, k: F.when((x["g"] == F.get(p, k - 1)["g"]) | (x["g"] == F.get(p, k + 1)["g"]), x["i"]))
        return _let(F.sort_array(F.filter(twice, lambda x: x.isNotNull())), lambda at: F.aggregate(
            F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    windows = F.slice(F.transform(w, lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))), 1, F.greatest(n - 2, F.lit(0)))
    return F.when(_let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h)), F.lit(0)).otherwise(_let(F.sort_array(windows), count))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def base(text: Column) -> Column:
    """A struct of the counts of a text."""
    t = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).cast("long").alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    words = _let(F.array_remove(F.split(t, SPACE), ""), of_words)
    lines = _let(F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\x0b\x0c\r", "    "))) > 0), of_lines)
    return F.struct(words.alias("w"), lines.alias("l"), F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"))


def counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` columns with the base counts, ``base_failed`` and the transformed statistics."""
    rows = docs.select(*keep, base(F.col(text)).alias("b")).select(*keep, "b.w.n_words", "b.w.word_chars", "b.n_symbols", "b.l.n_dup_lines", "b.w.n_repeat_words", "b.l.n_lines", "b.n_capitals")
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).withColumns({
        "length": F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)), "symbols": share("n_symbols", "word_chars"), "lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"), "capitals": share("n_capitals", "word_chars"),
    })


KEYS = ("grp", "start")


def _cell(i: int, j: int) -> str:
    return f"c{max(i, j)}{min(i, j)}"


def _inverse_root(est: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Groups with ``m0..`` (center) and the lower triangle ``c..`` of a covariance, to rows of the inverse Cholesky factor ``r..`` and ``logdet``."""
    p = len(STATS)
    for j in range(p):  # one projection a column keeps the expressions small
        diagonal = F.col(_cell(j, j)) - sum((F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0))
        est = est.withColumn(f"l{j}{j}", F.sqrt(F.greatest(diagonal, F.lit(1e-12))))
        est = est.withColumns({f"l{i}{j}": (F.col(_cell(i, j)) - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}") for i in range(j + 1, p)})
    for i in range(p):
        est = est.withColumns({f"r{i}{j}": (1 / F.col(f"l{i}{i}")) if i == j else -sum((F.col(f"l{i}{k}") * F.col(f"r{k}{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l{i}{i}") for j in range(i + 1)})
    logdet = sum((2 * F.log(f"l{i}{i}") for i in range(p)), F.lit(0.0)).alias("logdet")
    return est.select(*keys, *[f"m{i}" for i in range(p)], *[f"r{i}{j}" for i in range(p) for j in range(i + 1)], logdet)


def _distance() -> Column:
    p = len(STATS)
    z = [sum((F.col(f"r{i}{j}") * (F.col(STATS[j]) - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(p)]
    return sum((x * x for x in z), F.lit(0.0))


def _moments(inner: DataFrame, below: Column, want: Column, factor: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Mean and covariance times ``factor`` by ``keys``: rows ``below`` count one each, the others share what they leave of ``want``.

    From plain sums, which stay in generated code: the statistics are of the order of one, and FLOOR is far above what is
    lost in a difference of doubles.
    """
    p = len(STATS)
    cells = [(i, j) for i in range(p) for j in range(i + 1)]
    sums = inner.groupBy(*keys, below.alias("below")).agg(
        F.count("*").alias("n"), F.max(want).alias("want"), *[F.sum(c).alias(f"a{i}") for i, c in enumerate(STATS)], *[F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"q{i}{j}") for i, j in cells]
    )
    side = lambda c, v: F.coalesce(F.max(F.when(F.col("below") == v, F.col(c))), F.lit(0.0))
    names = ["n", *[f"a{i}" for i in range(p)], *[f"q{i}{j}" for i, j in cells]]
    both = sums.groupBy(*keys).agg(F.max("want").alias("want"), *[side(c, v).alias(f"{c}_{k}") for c in names for k, v in ((1, True), (0, False))])
    both = both.withColumn("share", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("want") - F.col("n_1")) / F.greatest(F.col("n_0"), F.lit(1.0)))))
    whole = lambda c: F.col(f"{c}_1") + F.col("share") * F.col(f"{c}_0")
    both = both.withColumn("w", whole("n")).where("w > 0").withColumns({f"m{i}": whole(f"a{i}") / F.col("w") for i in range(p)})
    spread = lambda i, j: whole(f"q{i}{j}") / F.col("w") - F.col(f"m{i}") * F.col(f"m{j}")
    return both.select(*keys, *[f"m{i}" for i in range(p)], *[((F.greatest(spread(i, j), F.lit(0.0)) if i == j else spread(i, j)) * factor + (FLOOR[i] ** 2 if i == j else 0.0)).alias(_cell(i, j)) for i, j in cells])


def _starts(stats: DataFrame) -> DataFrame:
    """Three estimates of each group to begin with."""
    p = len(STATS)
    cells = [(i, j) for i in range(p) for j in range(i + 1)]
    median = lambda c: F.percentile_approx(c, 0.5, 1000)
    center = written(stats.groupBy("grp").agg(*[median(c).alias(f"m{i}") for i, c in enumerate(STATS)]), "mcd-center")
    spread = stats.join(small(center), "grp").groupBy("grp").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(p)], *[median(F.abs(F.col(c) - F.col(f"m{i}"))).alias(f"s{i}") for i, c in enumerate(STATS)]
    )
    scaled = written(spread.withColumns({f"s{i}": F.sqrt((1.4826 * F.col(f"s{i}")) ** 2 + FLOOR[i] ** 2) for i in range(p)}), "mcd-scale")
    z = stats.join(small(scaled), "grp").select("grp", *[((F.col(c) - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i, c in enumerate(STATS)])
    z = z.withColumn("norm", F.greatest(sum((F.col(f"z{i}") ** 2 for i in range(p)), F.lit(0.0)), F.lit(1e-12)))
    forms = {1: lambda i: F.tanh(f"z{i}"), 2: lambda i: F.col(f"z{i}") / F.sqrt("norm")}
    found = written(z.groupBy("grp").agg(*[F.avg(f(i) * f(j)).alias(f"t{k}_{i}{j}") for k, f in forms.items() for i, j in cells]), "mcd-shapes").join(scaled, "grp")
    def linked(k: int, i: int, j: int) -> Column:  # off the diagonal a little less, so that the matrix stays positive
        return 0.95 * F.col(f"t{k}_{i}{j}") / F.sqrt(F.greatest(F.col(f"t{k}_{i}{i}") * F.col(f"t{k}_{j}{j}"), F.lit(1e-12)))

    def start(k: int) -> DataFrame:
        shape = {(i, j): F.lit(1.0) if i == j else linked(k, i, j) if k else F.lit(0.0) for i, j in cells}
        return found.select("grp", F.lit(k).alias("start"), *[f"m{i}" for i in range(p)], *[(shape[i, j] * F.col(f"s{i}") * F.col(f"s{j}")).alias(_cell(i, j)) for i, j in cells])

    return start(0).unionByName(start(1)).unionByName(start(2))


def fit(stats: DataFrame) -> DataFrame:
    """MCD estimates by ``grp``: mean ``m``, covariance ``c`` and number of documents ``n``, written to the shared folder."""
    p = len(STATS)
    cells = [_cell(i, j) for i in range(p) for j in range(i + 1)]
    est = written(_inverse_root(_starts(stats)), "mcd-start")
    ended, step = [est.withColumn("falls", F.lit(False)).limit(0)], 0
    while est.take(1):
        far = stats.join(small(est), "grp").select(*KEYS, *STATS, _distance().alias("d2"))
        limit = written(far.groupBy(*KEYS).agg(F.percentile_approx("d2", SUBSET, 1000).alias("limit"), F.count("*").alias("n_all")), "mcd-limit")
        inner = far.join(small(limit), list(KEYS)).where(F.col("d2") <= F.col("limit"))
        new = _inverse_root(_moments(inner, F.col("d2") < F.col("limit"), F.col("n_all") * SUBSET, CONSISTENT))
        before = est.select(*KEYS, F.col("logdet").alias("before"))
        falls = F.lit(step == 0) | (F.col("logdet") < F.col("before") - LEAST_FALL)
        new = written(new.join(before, list(KEYS)).withColumn("falls", falls), "mcd-step")
        ended.append(est.join(new.where("NOT falls").select(*KEYS), list(KEYS), "left_semi").withColumn("falls", F.lit(False)))
        est, step = new.where("falls").drop("before"), step + 1
        if step == TRIED:  # only the best start of each group goes on
            leading = functools.reduce(DataFrame.unionByName, [*ended, est])
            row = F.struct("logdet", *[c for c in est.columns if c not in ("grp", "logdet")])
            leading = written(leading.groupBy("grp").agg(F.min(row).alias("b")).select("grp", "b.*"), "mcd-leading")
            ended, est = [leading.where("NOT falls")], leading.where("falls")
        est = est.drop("falls")
    best = functools.reduce(DataFrame.unionByName, ended)
    row = F.struct("logdet", "start", *[c for c in best.columns if c[0] in "mr"])
    best = written(best.groupBy("grp").agg(F.min(row).alias("b")).select("grp", "b.*"), "mcd-best")
    far = stats.join(small(best), "grp").select("grp", *STATS, _distance().alias("d2"))
    shaped = _moments(far.where(F.col("d2") <= INNER), F.lit(True), F.lit(0.0), INNER_CONSISTENT, ("grp",))
    return written(shaped.join(stats.groupBy("grp").agg(F.count("*").alias("n")), "grp").select("grp", "n", *[f"m{i}" for i in range(p)], *cells), "mcd")


def _drawn(own: DataFrame, pool: DataFrame, groups: DataFrame) -> DataFrame:
    """Each group's estimate drawn towards its language's, as rows of the inverse root with the limit on the distance."""
    p = len(STATS)
    named = pool.select(F.col("grp").alias("pool"), F.col("n").alias("p_n"), *[F.col(c).alias(f"p_{c}") for c in pool.columns if c[0] in "mc"])
    both = own.join(groups, "grp").join(named, "pool").withColumn("w", F.col("n") / (F.col("n") + SHRINK))
    off = {i: F.col(f"m{i}") - F.col(f"p_m{i}") for i in range(p)}
    mixed = both.select(
        "grp", "p_n", *[(F.col("w") * F.col(f"m{i}") + (1 - F.col("w")) * F.col(f"p_m{i}")).alias(f"m{i}") for i in range(p)],
        *[(F.col("w") * F.col(_cell(i, j)) + (1 - F.col("w")) * F.col(f"p_{_cell(i, j)}") + F.col("w") * (1 - F.col("w")) * off[i] * off[j]).alias(_cell(i, j)) for i in range(p) for j in range(i + 1)],
    )
    return _inverse_root(mixed.withColumn("limit", CUTOFF * (1 + (FEW / F.col("p_n")) ** 2)), ("grp", "limit"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per document its counts, ``base_failed``, the squared robust distance ``d2`` and ``kept``."""
    pool = F.concat(F.lit("language "), F.to_json(F.struct(F.col(lang).alias("lang"))))
    own = F.concat(F.lit("source "), F.to_json(F.struct(F.col(lang).alias("lang"), F.col(source).alias("source"))))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), pool.alias("pool"), own.alias("grp"))
    stats = written(counts(rows, "text", ("doc_id", "pool", "grp")), "quality")
    fitted = stats.where(~F.col("base_failed"))
    groups = written(fitted.select("grp", "pool").distinct(), "quality-groups")
    levels = fitted.select(F.explode(F.array("grp", "pool")).alias("grp"), *STATS)  # each document counts for its source and its language
    mcd = fit(levels)
    est = written(_drawn(mcd.join(groups.select("grp"), "grp", "left_semi"), mcd, groups), "mcd-drawn")
    judged = stats.join(small(est), "grp", "left").withColumn("d2", _distance())
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= F.col("limit"), F.lit(True)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2", "grp", *STATS)
