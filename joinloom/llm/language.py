"""Language identification of mixed text: scripts narrow candidates, Viterbi labels spans of words.

Training takes a bounded sample: of each language the ``TRAIN_DOCS`` labelled documents of the training split that come
first by hash of their id (fewer where more than ``TRAIN_ALL`` / ``TRAIN_DOCS`` languages share ``TRAIN_ALL``), and of each
the first ``TRAIN_CHARS`` characters.  So every label is learned, however rare.  It counts hashed character n-grams (one to three
code points, word borders included) and the scripts of letters for each language.

A word (a run of letters and marks) takes the script of its first letter; languages that (nearly) never use that
script aren't candidates for it, and where no learned language uses it the word says nothing.  A word's score
under a language is the sum of the n-grams' log-likelihoods against the mean of the languages.  Viterbi over the
words of a document, with a fixed penalty for a switch of language, gives the spans.  A word whose best language leads
by twice the penalty decides its state whatever stands around it, so documents are cut there, exactly, and the short
stretches run side by side in numpy.

The prediction is the language with most letters on the path (ties: the first in order), the score its share of
letters.  Letters of words in a script that no language uses speak for none.  The score is 0 where the language's words are
unlike it: their mean log-likelihood per n-gram must come within ``MARGIN`` (and ``NOISE`` over the root of the number of
n-grams) of what is usual for the language's own documents under a model of the other half of the sample.  Null texts and texts without a letter are ``und`` with score 0, and so is everything where nothing was
learned.  Repeated rows are predicted each for itself.  Input columns named ``lang_pred``, ``score`` or ``spans``
are replaced.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow, pieces, read_table, ship, utf8

TRAIN_DOCS = 1000
TRAIN_ALL = 20_000
TRAIN_CHARS = 50_000
BUCKETS = 1 << 17
PENALTY = 6.0
SCALE = 0.5
SHARE = 0.01
BARRED = -4.0
#: How far below the usual log-likelihood per n-gram (nats) a document may lie.
MARGIN, NOISE = 2.0, 12.0

# First and last code point of scripts.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF),
    ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF),
    ("malayalam", 0xD00, 0xD7F), ("thai", 0xE00, 0xE7F), ("lao", 0xE80, 0xEFF), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FA1F),
)


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 0 none, 1 mark, 2 letter; lower case; number of the script (0: any other)."""
    letter = np.zeros(0x110000, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x32000):
        k = unicodedata.category(chr(c))[0]
        letter[c] = {"L": 2, "M": 1}.get(k, 0)
        low = chr(c).lower()
        if len(low) == 1:
            lower[c] = ord(low)
    script = np.zeros(0x110000, np.uint8)
    names = {name: i + 1 for i, name in enumerate(dict.fromkeys(s[0] for s in SCRIPTS))}
    for name, a, b in SCRIPTS:
        script[a : b + 1] = names[name]
    return letter, lower, script


N_SCRIPTS = len({s[0] for s in SCRIPTS}) + 1


def grams(points: np.ndarray, inside: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word, and bucket numbers (4, n) of the n-grams that end at each code point of a word."""
    _, lower, _ = tables()
    n = len(points)
    code = np.zeros(n + 3, np.uint64)
    code[2 : n + 2] = np.where(inside, lower[points], 0)
    prev_in = np.zeros(n, bool)
    prev_in[1:] = inside[:-1]
    start = inside & (~prev_in | first)
    a, b = code[2 : n + 2], np.where(start, np.uint64(0), code[1 : n + 1])
    second = np.zeros(n, bool)
    second[1:] = start[:-1]
    c = np.where(start | second, np.uint64(0), code[:n])
    nxt = code[3 : n + 3].copy()
    nxt[:-1][first[1:]] = 0
    out = np.empty((4, n), np.int64)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    m1, m2, m3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    one = (a + np.uint64(1)) * m1
    two = one ^ ((b + np.uint64(7)) * m2)
    out[0] = one >> shift
    out[1] = (two * m1) >> shift
    out[2] = ((two + (c + np.uint64(11)) * m3) * m1) >> shift
    out[3] = ((one ^ ((nxt + np.uint64(13)) * m3)) * m2) >> shift
    return np.flatnonzero(start), out


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # (buckets, languages)
    barred: np.ndarray  # (scripts, languages): penalties
    silent: np.ndarray  # (scripts,): no language uses it
    mean: np.ndarray  # (buckets,): the languages' mean log-likelihood
    usual: np.ndarray  # (languages,): log-likelihood per n-gram of documents that weren't trained on


def decoded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, the offsets of documents in them and marks of their starts."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    upto = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=upto[1:])
    at = upto[at - at[0]]
    first = np.zeros(len(points) + 1, bool)
    first[at] = True
    return points, at, first[:-1]


def _logs(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * max(1, np.count_nonzero(counts.sum(0)))))


def train(texts: list[str], labels: list[str]) -> Model:
    languages = tuple(sorted(set(labels)))
    k = len(languages)
    halves = np.zeros((2, k, BUCKETS))  # of every other document
    scripts = np.zeros((k, N_SCRIPTS))
    letter, _, script = tables()

    def parts(which: int, half: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        own = [t for t, x in zip(texts, labels, strict=True) if x == languages[which]][half::2]
        data, at = utf8(pa.array(own, pa.string()))
        for i, j in pieces(at):
            points, ends, first = decoded(data[at[i] : at[j]], at[i : j + 1])
            yield points, ends, first

    for which in range(k):
        for half in range(2):
            for points, _, first in parts(which, half):
                inside = letter[points] > 0
                _, found = grams(points, inside, first)
                halves[half, which] += np.bincount(found[:, inside].reshape(-1), minlength=BUCKETS)
                scripts[which] += np.bincount(script[points[letter[points] == 2]], minlength=N_SCRIPTS)
    usual = np.full(k, -np.inf)
    others = [_logs(halves[1]), _logs(halves[0])]
    for which in range(k):
        seen = []
        for half in range(2):
            for points, ends, first in parts(which, half):
                inside = letter[points] > 0
                _, found = grams(points, inside, first)
                sums = np.concatenate(([0.0], np.cumsum(np.where(inside, others[half][which][found].sum(0), 0.0))))
                n = np.concatenate(([0], np.cumsum(4 * inside)))
                n, sums = np.diff(n[ends]), np.diff(sums[ends])
                seen.append(sums[n > 0] / n[n > 0])
        seen = np.concatenate([np.zeros(0), *seen])
        if len(seen):
            usual[which] = np.median(seen)
    counts = halves.sum(0)
    logs = _logs(counts)
    mean = logs.mean(0) if k else np.zeros(BUCKETS)
    share = scripts / np.maximum(1, scripts.sum(1, keepdims=True))
    uses = share >= SHARE
    barred = np.where(uses | ~uses.any(0), 0.0, BARRED).T
    never = counts.sum(0) == 0
    weights = np.where(never, 0.0, (logs - mean) * SCALE)
    return Model(languages, weights.T.astype(np.float32), barred.astype(np.float32), ~uses.any(0), mean.astype(np.float32), usual)


def viterbi(scores: np.ndarray, begin: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best language of each word; ``begin``: the first word of each document, increasing, all words covered."""
    n, k = scores.shape
    if not n:
        return np.zeros(0, np.int8)
    rows = np.arange(n)
    best = scores.argmax(1)
    rest = scores.copy()
    rest[rows, best] = -np.inf
    sure = (scores[rows, best] - rest.max(1) >= 2 * penalty) if k > 1 else np.ones(n, bool)
    starts = np.zeros(n + 1, bool)
    starts[begin] = True
    is_first = starts.copy()
    starts[1:] |= sure
    at = np.flatnonzero(starts[:-1])
    length = np.diff(np.append(at, n))
    order = np.argsort(-length, kind="stable")
    at, length = at[order], length[order]
    value = np.zeros((len(at), k), np.float32)
    bound = np.flatnonzero(~is_first[at])
    value[bound] = -penalty
    value[bound, best[at[bound] - 1]] = 0
    stay = np.ones((n, k), bool)
    source = np.zeros(n, np.int8)  # the language to come from on a switch into word t
    steps = int(length[0])
    active = np.searchsorted(-length, -np.arange(steps), "left")  # stretches longer than t
    for t in range(steps):
        m = active[t]
        here = at[:m] + t
        v = value[:m]
        top = v.argmax(1)
        jump = v[np.arange(m), top] - penalty
        source[here] = top
        keep = v >= jump[:, None]
        stay[here] = keep
        value[:m] = np.where(keep, v, jump[:, None]) + scores[here]
    out = np.zeros(n, np.int8)
    now = value.argmax(1).astype(np.int8)
    ends_sure = sure[at + length - 1]
    now[ends_sure] = best[(at + length - 1)[ends_sure]]
    for t in range(steps - 1, -1, -1):
        m = active[t]
        here = at[:m] + t
        out[here] = now[:m]
        now[:m] = np.where(stay[here, now[:m]], now[:m], source[here])
    return out


def label(model: Model, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of each document by language, per word: document, start, end (code points), language; per document all letters and whether its language's words are like it."""
    points, at, first = decoded(data, at)
    letter, _, script = tables()
    kind = letter[points]
    inside = kind > 0
    start, found = grams(points, inside, first)
    docs, k = len(at) - 1, len(model.languages)
    empty = np.zeros(0, np.int64)
    if not len(start) or not k:
        return np.zeros((docs, max(1, k))), empty, empty, empty, empty, np.zeros(docs), np.zeros(docs, bool)
    within = np.flatnonzero(inside)
    cut = np.searchsorted(within, start)
    each = np.take(model.weights, found[0, within], axis=0)
    for row in found[1:]:
        each += np.take(model.weights, row[within], axis=0)
    scores = np.add.reduceat(each, cut, axis=0)
    level = np.add.reduceat(model.mean[found[:, within]].sum(0, dtype=np.float64), cut)[:, None] + scores / SCALE
    scores += model.barred[script[points[start]]]
    silent = model.silent[script[points[start]]]
    scores[silent] = 0
    np.clip(scores - scores.max(1, keepdims=True), -2.5 * PENALTY, 0, out=scores)
    doc = np.searchsorted(at, start, "right") - 1
    begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    path = viterbi(scores, begin)
    letters = np.add.reduceat((kind[within] == 2).astype(np.int64), cut)
    ends = within[np.append(cut[1:], len(within)) - 1] + 1
    by = np.bincount(doc * k + path, weights=np.where(silent, 0, letters), minlength=docs * k).reshape(docs, k)
    top = by.argmax(1)
    own = ~silent & (path == top[doc])
    n = np.bincount(doc[own], weights=4.0 * np.diff(np.append(cut, len(within)))[own], minlength=docs)
    reached = np.bincount(doc[own], weights=level[own, path[own]], minlength=docs) / np.maximum(1, n)
    like = (n > 0) & (reached >= model.usual[top] - MARGIN - NOISE / np.sqrt(np.maximum(1, n)))
    return by, doc, start - at[doc], ends - at[doc], path, np.bincount(doc, weights=letters, minlength=docs), like


MADE = T.StructType([
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))),
])


def _predict(batches: Iterator[pa.RecordBatch], model: Model, text: str, keep: list[str], spans: bool) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_type

    names = keep + ["lang_pred", "score"] + ["spans"] * spans
    span_type = to_arrow_type(MADE["spans"].dataType)
    for batch in batches:
        data, at = utf8(batch.column(batch.schema.get_field_index(text)))
        for i, j in pieces(at):
            by, doc, start, end, path, total, like = label(model, data[at[i] : at[j]], at[i : j + 1])
            top = by.argmax(1)
            lang = [model.languages[t] if n else "und" for t, n in zip(top.tolist(), total.tolist(), strict=True)]
            score = np.where(like, by[np.arange(len(by)), top] / np.maximum(1, total), 0.0)
            part = batch.slice(i, j - i)
            made = [pa.array(lang), pa.array(score, pa.float64())]
            if spans:
                change = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (path[1:] != path[:-1]))) if len(doc) else np.zeros(0, np.int64)
                last = np.append(change[1:], len(doc)) - 1
                rows: list[list] = [[] for _ in range(j - i)]
                for d, s, e, p in zip(doc[change].tolist(), start[change].tolist(), end[last].tolist(), path[change].tolist(), strict=True):
                    rows[d].append({"start": s, "end": e, "lang": model.languages[p]})
                made.append(pa.array(rows, span_type))
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in keep] + made, names=names)


def held_out(doc_id: str | Column) -> Column:
    """Whether a document is kept from training; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = TRAIN_DOCS) -> Model:
    """A model of the bounded sample; ``docs`` includes held-out rows, which aren't read."""
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("l").isNotNull() & F.col("t").isNotNull() & ~held_out("i"))
    labels = rows.select("l").distinct().count()
    each = max(1, min(most, TRAIN_ALL // max(1, labels)))
    order = Window.partitionBy("l").orderBy("h", "i")
    first = rows.select("l", "i", F.xxhash64("i").alias("h")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).select("l", "i").distinct()
    picked = rows.join(F.broadcast(first), rows["l"].eqNullSafe(first["l"]) & rows["i"].eqNullSafe(first["i"]), "left_semi")
    again = Window.partitionBy("l").orderBy("h", "i", "t")  # rows may repeat an id
    sample = picked.select("i", "l", F.substring("t", 1, TRAIN_CHARS).alias("t"), F.xxhash64("i").alias("h")).withColumn("k", F.row_number().over(again)).where(F.col("k") <= each).select("t", "l").collect()
    return train([r[0] for r in sample], [r[1] for r in sample])


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, spans: bool = False) -> DataFrame:
    ship(docs.sparkSession)
    made = {"lang_pred", "score"} | ({"spans"} if spans else set())
    names = [c for c in (docs.columns if keep is None else keep) if c not in made or c == text]
    schema = T.StructType([docs.schema[c] for c in names] + [f for f in MADE.fields if f.name in made])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return arrow(docs.select(*dict.fromkeys([*names, text])), lambda it: _predict(it, shared.value, text, names, spans), schema)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    got = predict(docs.select("doc_id", "text"), fit(docs), keep=["doc_id"])
    return got.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
