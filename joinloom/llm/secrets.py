"""Secret scans: base patterns plus a randomness test battery with false-discovery control.

Base patterns (fixed by contract) find assignments, access keys and long hexadecimal runs.  The battery looks at
what is left, after those, of every run of ``[A-Za-z0-9+/_=-]``, in parts of ``LEAST`` or more characters:

1. the encoding is inferred from the characters used (dec, hex, base32, base64, base64url or alnum);
2. three statistics over that alphabet: chi-squared against uniformity, the number of runs about the alphabet's middle,
   and the lag-one serial correlation.  Against randomness they give a combined p-value (smallest times three); a token
   below ``RANDOM_P`` isn't random, whatever else it is;
3. against ordinary text: how the statistics would fall out in tokens of the same length and alphabet written with the
   characters, and the successions of characters, of the whole corpus (one table of bigrams, counted over all
   documents).  Their distances from that, each in standard deviations and towards randomness, are added (Stouffer);
   the normal tail of the sum is the token's p-value.  It falls with length, as the deviations of random text add up;
4. Benjamini-Hochberg at ``FDR`` over these p-values within strata of length, over all tokens of the corpus.  The
   counts behind it are a histogram of fixed size (strata times bins).

The bigram table and the histogram, both of fixed size, are all that reaches the driver.  Work is linear in a text: code
points are counted once, and spans are cut by merging sorted lists.

Nulls and empty texts have no spans.  Repeated rows are scanned each for itself.  Input columns named like an output
column (``secrets``, ``n_assign``, ``n_access``, ``n_hex``, ``n_random``, ``base_sha256``, ``spans``) are replaced by
``find_secrets``; all other columns, whatever their names, pass through.  ``redact`` keeps all columns.  Offsets are
code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow, pieces, read_table, ship, total, unused, utf8, written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST = 20
RANDOM_P = 0.01
FDR = 0.01
STRATA = (20, 28, 40, 64, 128)
BINS = 400
PER_NAT = 4

#: No statistic counts for more standard deviations than this: normal tails aren't to be trusted further out.
MOST_Z = 8.0

_COUNTS = [T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()), T.StructField("base_sha256", T.StringType())]
_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("end", T.LongType())])
_FOUND = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("stratum", T.IntegerType()), T.StructField("bin", T.IntegerType())])


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_UPPER, _LOWER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_IS_HEX = _table(b"0123456789abcdef")
_IS_TOKEN = _table(_UPPER + _LOWER + _DIGITS + b"+/_=-")
_ALPHABETS = (
    ("dec", _DIGITS), ("hex", b"0123456789abcdef"), ("hex", b"0123456789ABCDEF"), ("base32", _UPPER + b"234567"),
    ("alnum", _DIGITS + _UPPER + _LOWER), ("base64", _UPPER + _LOWER + _DIGITS + b"+/"), ("base64url", _UPPER + _LOWER + _DIGITS + b"-_"),
)


def infer_encoding(token: bytes) -> tuple[str, bytes]:
    """The smallest alphabet that holds all characters; trailing padding isn't counted."""
    body = set(token.rstrip(b"="))
    for name, alphabet in _ALPHABETS:
        if body <= set(alphabet):
            return name, alphabet
    return "mixed", _UPPER + _LOWER + _DIGITS + b"+/_=-"


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def bigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each byte follows each other one, over all texts."""

    def fill(table: np.ndarray, batch: pa.RecordBatch) -> None:
        data, at = utf8(batch.column(0))
        for i, j in pieces(at):
            own = data[at[i] : at[j]]
            table += np.bincount(own[:-1].astype(np.int64) << 8 | own[1:], minlength=1 << 16)

    return total(docs.select(text), fill, 1 << 16, np.int64, np.add)[0]


class Natural:
    """Mean and variance of the battery's statistics in ordinary text, by alphabet."""

    def __init__(self, table: np.ndarray):
        self.table = table.reshape(256, 256)
        self.known: dict[bytes, tuple[float, ...]] = {}

    def of(self, alphabet: bytes) -> tuple[float, ...]:
        """Sums of squares and cubes of the shares of the alphabet's characters, the share of successions that cross its middle, and their correlation."""
        if alphabet not in self.known:
            at = np.frombuffer(alphabet, np.uint8)
            size = len(at)
            pair = self.table[np.ix_(at, at)] + 1.0 / size  # what never occurs still may
            share = pair.sum(1) + pair.sum(0)
            share /= share.sum()
            pair /= pair.sum()
            half = np.arange(size) >= size / 2
            crossing = float(pair[half][:, ~half].sum() + pair[~half][:, half].sum())
            code = np.arange(size)
            ahead, behind = code - code @ pair.sum(1), code - code @ pair.sum(0)
            scale = math.sqrt(float((ahead**2) @ pair.sum(1)) * float((behind**2) @ pair.sum(0)))
            self.known[alphabet] = (float((share**2).sum()), float((share**3).sum()), crossing, float(ahead @ pair @ behind) / scale if scale else 0.0)
        return self.known[alphabet]

    def p(self, alphabet: bytes, n: int, chi: float, runs: int, serial: float) -> float:
        """How likely ordinary text of ``n`` characters is as random as that."""
        size = len(alphabet)
        two, three, crossing, linked = self.of(alphabet)
        mean = size * (1 - two) + n * (size * two - 1)
        var = (size / n) ** 2 * 2 * n * (n - 1) * (two + 2 * (n - 2) * three - (2 * n - 3) * two**2)
        z = [(mean - chi) / math.sqrt(var) if var > 0 else 0.0]
        towards = 1 if crossing < 0.5 else -1  # random text crosses the middle half of the time
        z.append(towards * (runs - 1 - (n - 1) * crossing) / math.sqrt((n - 1) * crossing * (1 - crossing)) if 0 < crossing < 1 else 0.0)
        z.append((1 if linked > 0 else -1) * (linked - serial) * math.sqrt(n))
        return 0.5 * math.erfc(sum(max(-MOST_Z, min(MOST_Z, x)) for x in z) / math.sqrt(2 * len(z)))


def statistics(code: np.ndarray, size: int) -> tuple[float, int, float]:
    """Chi-squared against uniformity, runs about the middle and lag-one correlation of a token's codes."""
    n = len(code)
    counts = np.bincount(code, minlength=size)
    above = code >= size / 2
    dev = code - code.mean()
    spread = float((dev * dev).sum())
    return float((counts * counts).sum()) * size / n - n, 1 + int((above[1:] != above[:-1]).sum()), float((dev[1:] * dev[:-1]).sum()) / spread if spread else 1.0


def battery(token: bytes, natural: Natural) -> tuple[float, float]:
    """The combined p-value against randomness, and the p-value against ordinary text."""
    name, alphabet = infer_encoding(token)
    body = token.rstrip(b"=") if name != "mixed" else token
    n, size = len(body), len(alphabet)
    if n < 4:
        return 0.0, 1.0
    lookup = np.zeros(256, np.int64)
    lookup[list(alphabet)] = np.arange(size)
    code = lookup[np.frombuffer(body, np.uint8)]
    chi, runs, serial = statistics(code, size)
    k = size - 1
    z = ((chi / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    p_chi = min(1.0, 0.5 * math.erfc(z / math.sqrt(2)))
    n1 = int((code >= size / 2).sum())
    n0 = n - n1
    if n1 and n0:
        mean = 1 + 2 * n0 * n1 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = _two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    p_serial = _two_sided(serial * math.sqrt(n)) if len(set(body)) > 1 else 0.0
    return min(1.0, 3 * min(p_chi, p_runs, p_serial)), natural.p(alphabet, n, chi, runs, serial)


def _runs(inside: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of at least ``least`` bytes; a run ends where a document starts."""
    edge = np.flatnonzero((inside[1:] != inside[:-1]) | first[1:]) + 1
    edge = np.concatenate(([0], edge, [len(inside)]))
    start, end = edge[:-1], edge[1:]
    keep = (end - start >= least) & inside[np.minimum(start, len(inside) - 1)]
    return start[keep], end[keep]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the base patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(found)


def cut(start: int, end: int, spans: list[tuple[int, int]], k: int) -> tuple[list[tuple[int, int]], int]:
    """What sorted, disjoint ``spans`` leave of start..end, and the first span that a later run may meet; looking starts at ``k``."""
    out = []
    while k < len(spans) and spans[k][1] <= start:
        k += 1
    i = k
    while i < len(spans) and spans[i][0] < end:
        if spans[i][0] > start:
            out.append((start, spans[i][0]))
        start = max(start, spans[i][1])
        i += 1
    if start < end:
        out.append((start, end))
    return out, k


def scan_piece(data: np.ndarray, at: np.ndarray, natural: Natural) -> dict[int, tuple[list, list]]:
    """For each document of a piece with any span: its base spans and the battery's candidates."""
    at = at - at[0]
    if not len(data):
        return {}
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    raw = data.tobytes()
    docs: set[int] = set()

    def hit(positions: np.ndarray | list[int]) -> None:
        docs.update((np.searchsorted(at, np.asarray(positions, np.int64), "right") - 1).tolist())

    hit(_runs(_IS_HEX[data], first[:-1], 32)[0])
    low = raw.lower()
    for where, needles in ((low, KEYWORDS), (raw, (b"AKIA",))):
        for needle in needles:
            p, positions = where.find(needle), []
            while p >= 0:
                positions.append(p)
                p = where.find(needle, p + 1)
            hit(positions)
    start, end = _runs(_IS_TOKEN[data], first[:-1], LEAST)
    doc = np.searchsorted(at, start, "right") - 1
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32))) if len(start) else None
    runs: dict[int, list[tuple[int, int, int]]] = {}
    if len(start):
        for d, s, e, before in zip(doc.tolist(), start.tolist(), end.tolist(), (points[start] - points[at[doc]]).tolist(), strict=True):
            runs.setdefault(d, []).append((s, e, before))
    out = {}
    for d in docs | runs.keys():
        base = base_spans(raw[at[d] : at[d + 1]].decode("utf-8", "replace")) if d in docs else []
        covered: list[tuple[int, int]] = []
        for s, _, e in base:
            if covered and s <= covered[-1][1]:
                covered[-1] = (covered[-1][0], max(e, covered[-1][1]))
            else:
                covered.append((s, e))
        found, k = [], 0
        for s, e, before in runs.get(d, ()):
            parts, k = cut(before, before + e - s, covered, k)
            for a, b in parts:
                if b - a >= LEAST:
                    p_random, p = battery(raw[s + a - before : s + b - before], natural)
                    bin_ = min(BINS - 1, int(-math.log(max(p, 1e-300)) * PER_NAT)) if p_random >= RANDOM_P else 0
                    found.append((a, b, sum(b - a >= x for x in STRATA) - 1, bin_))
        if base or found:
            out[d] = (base, found)
    return out


def _digest(base: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()


def _scan(batches: Iterator[pa.RecordBatch], text: str, keep: list[str], natural: Natural, made_names: list[str]) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in _COUNTS] + [to_arrow_type(T.ArrayType(x)) for x in (_SPAN, _FOUND)]
    none = _digest([])
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        data, at = utf8(column)
        n = len(column)
        counts = np.zeros((3, n), np.int64)
        digests, bases, founds = [none] * n, [[] for _ in range(n)], [[] for _ in range(n)]
        for i, j in pieces(at):
            for d, (base, found) in scan_piece(data[at[i] : at[j]], at[i : j + 1], natural).items():
                for _, k, _ in base:
                    counts[k, i + d] += 1
                digests[i + d] = _digest(base)
                bases[i + d] = [{"start": s, "rank": k, "end": e} for s, k, e in base]
                founds[i + d] = [dict(zip(_FOUND.names, x, strict=True)) for x in found]
        made = [counts[0], counts[1], counts[2], digests, bases, founds]
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(x, t) for x, t in zip(made, kinds, strict=True)],
            names=keep + made_names,
        )


def thresholds(histogram: dict[tuple[int, int], int], q: float = FDR) -> list[int]:
    """The first bin that Benjamini-Hochberg accepts, for each stratum; bin 0 holds what isn't random."""
    out = []
    for stratum in range(len(STRATA)):
        counts = [histogram.get((stratum, b), 0) for b in range(BINS)]
        total, above, first = sum(counts), 0, BINS
        for b in range(BINS - 1, 0, -1):
            above += counts[b]
            if counts[b] and math.exp(-b / PER_NAT) <= q * above / total:
                first = b
        out.append(first)
    return out


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets`` (array of kind, start, end), counts, the base digest and ``spans``."""
    spark = docs.sparkSession
    ship(spark)
    made = {"secrets", "n_random", "spans", *(f.name for f in _COUNTS)}
    keep = [c for c in docs.columns if c == text or c not in made]
    of_base, of_found = unused("jl_base", keep), unused("jl_found", keep)
    out = T.StructType([docs.schema[c] for c in keep] + _COUNTS + [T.StructField(of_base, T.ArrayType(_SPAN)), T.StructField(of_found, T.ArrayType(_FOUND))])
    natural, names = Natural(bigrams(docs, text)), out.names[len(keep) :]
    rows = written(arrow(docs.select(*[F.col(f"`{c}`") for c in keep]), lambda it: _scan(it, text, keep, natural, names), out), "secrets")
    seen = rows.select(F.explode(of_found).alias("x")).groupBy("x.stratum", "x.bin").count().collect()
    limit = thresholds({(r[0], r[1]): r[2] for r in seen})
    limits = F.array(*map(F.lit, limit))
    found = F.filter(of_found, lambda x: x["bin"] >= F.get(limits, x["stratum"]))
    spans = F.array_sort(F.concat(of_base, F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("rank"), x["end"].alias("end")))))
    kinds = F.array(*map(F.lit, KINDS))
    named = F.transform(spans, lambda x: F.struct(F.get(kinds, x["rank"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return (
        rows.withColumn("secrets", F.when(F.size(of_base) + F.size(of_found) > 0, named).otherwise(F.array().cast(T.ArrayType(T.StructType([
            T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))))
        .withColumn("n_random", F.size(F.filter("secrets", lambda x: x["kind"] == "random")).cast("long"))
        .withColumn("spans", F.concat_ws(",", F.transform("secrets", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))))
        .drop(of_base, of_found)
    )


def _redact(batches: Iterator[pa.RecordBatch], keep: list[str], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        spans = batch.column(batch.schema.get_field_index("secrets")).to_pylist()
        for i, found in enumerate(spans):
            if found and texts[i]:
                out, done = [], 0
                for x in found:
                    if x["start"] >= done:
                        out += [texts[i][done : x["start"]], f"[{x['kind'].upper()}]"]
                    done = max(done, x["end"])
                texts[i] = "".join(out) + texts[i][done:]
        yield pa.RecordBatch.from_arrays(
            [pa.array(texts, pa.string()) if c == text else batch.column(batch.schema.get_field_index(c)) for c in keep], names=keep
        )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret replaced by its kind in brackets; all documents and columns stay."""
    keep = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*keep)  # columns of any name
    schema, own = rows.schema, keep[docs.columns.index(text)]
    return arrow(find_secrets(rows, own).select(*keep, "secrets"), lambda it: _redact(it, keep, own), schema).toDF(*docs.columns)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")

