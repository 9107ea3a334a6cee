r"""Chat formatting by columnar byte assembly.

Template: a turn is ``### Role: text</turn>`` and a newline, the role with a capital.  Inside roles and texts a
backslash goes before every ``\`` and ``#`` and before ``<`` where ``</turn>`` follows (in roles also before
``:`` and a newline), so no control string stands there unescaped and the escape can be undone.

Rows are dealt by conversation and sorted by turn; a task streams them batch by batch.  For about a megabyte of text at
a time the lengths of all segments, their cumulative offsets and the scatter indices are computed in numpy, and headers,
escaped contents and footers are copied into one preallocated buffer, which is the value buffer of the Arrow column as it
stands: the column's offsets are the cumulative offsets at which conversations begin.  A conversation gives one row, or
several parts in order where it is longer than ``PART_BYTES``; the last one of a batch waits for the next batch as rows, so a
conversation of any length streams through bounded memory.  The mask of the loss is a list of byte spans, one an assistant text.

Null texts and roles count as empty.  A null conv_id is a conversation of its own; null turns come first; rows that
tie on the turn are ordered by role, then text; repeated rows are turns each.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow, pieces, read_table, ship, utf8

HEAD, MIDDLE, FOOT = b"### ", b": ", b"</turn>\n"
END = b"</turn>"
ASSISTANT = "assistant"
PART_BYTES = 1 << 20
EXAMPLE = "\\### Assistant: </turn> ok"

PART = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("part", T.LongType()), T.StructField("n_turns", T.LongType()),
    T.StructField("formatted", T.BinaryType()), T.StructField("loss_start", T.ArrayType(T.LongType())), T.StructField("loss_end", T.ArrayType(T.LongType())),
])


def _marks(data: np.ndarray, role: bool) -> np.ndarray:
    """Whether each byte takes a backslash before it."""
    out = (data == 0x5C) | (data == 0x23)
    if role:
        return out | (data == 0x3A) | (data == 0x0A) | (data == 0x3C)
    at = np.flatnonzero(data[: max(0, len(data) - len(END) + 1)] == END[0])
    for k in range(1, len(END)):
        at = at[data[at + k] == END[k]]
    out[at] = True
    return out


def escaped(data: np.ndarray, at: np.ndarray, role: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Escaped bytes and offsets of texts one after another."""
    at = at - at[0]
    marks = _marks(data, role)
    upto = np.zeros(len(data) + 1, np.int64)
    np.cumsum(marks, out=upto[1:])
    out = np.full(len(data) + int(upto[-1]), 0x5C, np.uint8)
    out[np.arange(len(data)) + upto[1:]] = data
    return out, at + upto[at]


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns; offsets of the turns; start and end of each turn's text in the buffer."""
    n = len(role)
    names = pa.array([r[:1].upper() + r[1:] if r[:1].isascii() and r[:1].islower() else "=" + r for r in (x or "" for x in role.to_pylist())])
    parts = [escaped(*utf8(names), True), escaped(*utf8(text))]
    (r_data, r_at), (t_data, t_at) = parts
    r_len, t_len = np.diff(r_at), np.diff(t_at)
    lengths = np.stack([np.full(n, len(HEAD)), r_len, np.full(n, len(MIDDLE)), t_len, np.full(n, len(FOOT))], 1)
    ends = np.cumsum(lengths.reshape(-1)).reshape(n, 5)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for column, fixed in ((0, HEAD), (2, MIDDLE), (4, FOOT)):
        out[starts[:, column, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    for column, data, at, length in ((1, r_data, r_at, r_len), (3, t_data, t_at, t_len)):
        out[np.arange(len(data)) + np.repeat(starts[:, column] - at[:-1], length)] = data
    return out, np.append(starts[:, 0], len(out)), starts[:, 3], ends[:, 3]


def _column(rows: pa.RecordBatch, starts: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    """PART rows of parts that begin at rows ``starts`` (the first at 0), in one buffer."""
    from pyspark.sql.pandas.types import to_arrow_schema

    role = rows.column(1)
    data, offsets, begin, end = assemble(role, rows.column(2))
    ends = np.append(starts, len(rows))
    cuts = offsets[ends]
    said = np.flatnonzero(np.array([r == ASSISTANT for r in role.to_pylist()], bool))
    own = cuts[np.searchsorted(starts, said, "right") - 1]  # where the part of each assistant text begins
    spans = pa.array(np.searchsorted(said, ends), pa.int32())
    return pa.RecordBatch.from_arrays([
        rows.column(0).take(pa.array(starts)), pa.array(numbers, pa.int64()), pa.array(np.diff(ends), pa.int64()),
        pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)]),
        pa.ListArray.from_arrays(spans, pa.array(begin[said] - own)), pa.ListArray.from_arrays(spans, pa.array(end[said] - own)),
    ], schema=to_arrow_schema(PART))


def _format(batches: Iterator[pa.RecordBatch], most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    held, begun = None, 0  # rows of the last part so far, and its number in its conversation

    def parts(rows: pa.RecordBatch, open_: bool) -> Iterator[pa.RecordBatch]:
        """All parts of ``rows``; if ``open_``, the last one is held back."""
        nonlocal held, begun
        ids, (_, at) = rows.column(0).to_pylist(), utf8(rows.column(2))
        sizes, starts, numbers = at.tolist(), [0], [begun]
        for k in range(1, len(ids)):
            if ids[k] != ids[k - 1]:
                starts.append(k)
                numbers.append(0)
            elif sizes[k] - sizes[starts[-1]] > most:
                starts.append(k)
                numbers.append(numbers[-1] + 1)
        stop = len(ids)
        if open_:
            stop, begun = starts.pop(), numbers.pop()
            held = rows.slice(stop)
        starts, numbers = np.array(starts, np.int64), np.array(numbers, np.int64)
        edges = at[np.append(starts, stop)]
        for i, j in pieces(edges):
            first = int(starts[i])
            last = int(starts[j]) if j < len(starts) else stop
            yield _column(rows.slice(first, last - first), starts[i:j] - first, numbers[i:j])

    for batch in batches:
        if len(batch):
            yield from parts(batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0], True)
    if held is not None:
        yield from parts(held, False)


def format_chats(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations as PART rows; the parts of a conversation stand together, in order, in one partition."""
    ship(rows.sparkSession)
    rows = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(role).alias("role"), F.col(text).alias("text"), F.col(turn).alias("turn"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return arrow(dealt.select("conv_id", "role", "text"), _format, PART)


def unescape(data: bytes) -> bytes:
    """Without the backslash that stands before a byte."""
    if b"\\" not in data:
        return data
    x = np.frombuffer(data, np.uint8)
    slash = np.flatnonzero(x == 0x5C)
    keep = np.ones(len(x), bool)
    last = -1
    for p in slash.tolist():
        if p != last:  # an escape, not an escaped backslash
            keep[p] = False
            last = p + 1
    return x[keep].tobytes()


def _next(data: bytes, what: bytes, at: int) -> int:
    """Where an unescaped ``what`` starts from ``at`` on."""
    while True:
        p = data.find(what, at)
        if p < 0:
            raise ValueError("a turn isn't closed")
        k = p
        while k and data[k - 1] == 0x5C:
            k -= 1
        if (p - k) % 2 == 0:
            return p
        at = p + 1


def parse(formatted: bytes) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of formatted bytes."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(HEAD, at):
            raise ValueError(f"no turn starts at byte {at}")
        colon = _next(formatted, MIDDLE, at + len(HEAD))
        role = unescape(formatted[at + len(HEAD) : colon]).decode()
        close = _next(formatted, FOOT, colon + len(MIDDLE))
        yield role[1:] if role[:1] == "=" else role[:1].lower() + role[1:], unescape(formatted[colon + len(MIDDLE) : close]).decode()
        at = close + len(FOOT)


DIGESTS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
    T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of whole conversations from their parts, which arrive in order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(DIGESTS)
    state: list | None = None
    done: list[list] = []

    def close() -> None:
        if state is not None:
            done.append([state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]])

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        done.clear()
        return out

    for batch in batches:
        for conv, part, data, begin, end in zip(*(batch.column(k) for k in (0, 1, 3, 4, 5)), strict=True):
            if part.as_py() == 0 or state is None:
                close()
                state = [conv.as_py(), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            raw = data.as_buffer().to_pybytes()
            for role, text in parse(raw):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            for a, b in zip(begin.as_py(), end.as_py(), strict=True):
                said = unescape(raw[a:b])
                state[3] += len(said.decode())
                state[4].update(said)
            state[5] += len(raw.decode())
        if len(done) > 5000:
            yield flush()
    close()
    if done:
        yield flush()


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(EXAMPLE).alias("text"))
    return arrow(format_chats(rows.unionByName(extra)), _read_back, DIGESTS)


#: Every role in the table is lower case and needs no escape.
ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(t, r))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(14 + length(role) + length(text) + length(text) - length(replace(replace(text, '\', ''), '#', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
