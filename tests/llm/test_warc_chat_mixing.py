"""WARC, chat formatting and mixing against plain forms."""

from __future__ import annotations

import base64
import gzip
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinloom.llm import chat, mixing, warc
from joinloom.llm.common import fresh_path

from .helpers import WORD, documents, prose, rows_of

# --- WARC -----------------------------------------------------------------------------------------------------

TRICK = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAGES = [(1, "http://a.example/x?y#z", "<p>é</p>"), (2, "http://a.example", "<p>é</p>"), (3, "http://b.example/", TRICK), (4, None, None), (5, "http://c.example/\r\nEvil: 1", ""), (6, "u", "y" * 300_000), (7, "u", TRICK), (7, "u", TRICK), (None, "u", "lonely")]
SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("digest", T.StringType())])


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(*r, "clash") for r in PAGES], SCHEMA).repartition(3)
    path = fresh_path(spark, "test-warc")
    warc.write(df, path)
    rows = warc.assemble(warc.read(spark, path)).collect()
    assert len(rows) == len(PAGES)
    number = lambda s: None if s is None or ":null:" in s else int(s.split(":")[2])
    got = sorted(((number(r.response.record_id), r.response.type, r.response.payload_bytes, number(r.response.refers_to), r.response.payload) for r in rows), key=str)
    last = {}
    for i, _, h in PAGES:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in PAGES:
        body, is_last = (h or "").encode(), last[h or ""] == (-1 if i is None else i)
        want.append((i, "response" if is_last else "revisit", len(body), None if is_last else last[h or ""], body if is_last else b""))
    assert [(*g[:4], bytes(g[4])) for g in got] == sorted(want, key=str)
    for r in rows:
        assert r.request.concurrent_to is None and r.request.record_id == r.transaction == r.response.concurrent_to == r.metadata.concurrent_to
        assert r.request.head.startswith("GET ") and b"page-id: " in r.metadata.payload
        if r.response.type == "response":
            assert r.response.payload_digest == "sha1:" + r.response.actual_digest == "sha1:" + base64.b32encode(hashlib.sha1(r.response.payload).digest()).decode()


def test_warc_empty_table(spark):
    path = fresh_path(spark, "test-warc")
    warc.write(spark.createDataFrame([], SCHEMA), path)
    assert warc.assemble(warc.read(spark, path)).count() == 0


def test_warc_members_and_truncation():
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nContent-Length: 5\r\n\r\n\r\n\r\nx\r\n\r\n"
    for raw in (record * 3, gzip.compress(record) + gzip.compress(record * 2), gzip.compress(record * 3)):
        assert [r["payload"] for r in warc.records_of(raw)] == [b"\r\n\r\nx"] * 3
    with pytest.raises(ValueError):
        list(warc.records_of(record[:-6]))
    with pytest.raises(ValueError):
        list(warc.records_of(b"junk\r\n\r\n"))


def test_warc_chains_and_several_headers(spark, tmp_path):
    """metadata names the response, the response the request; a second capture's request is named by a record that names both others."""
    record = lambda kind, name, *to: (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\n" + "".join(f"WARC-Concurrent-To: <{t}>\r\n" for t in to) + f"Content-Length: {len(name) + 2}\r\n\r\n{name}\r\n\r\n\r\n").encode()
    first = [record("metadata", "m1", "r1"), record("response", "r1", "q1"), record("request", "q1")]
    second = [record("response", "r2"), record("metadata", "m2", "q2", "r2"), record("request", "q2")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, first + [record("request", "alone")])))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(second)))
    records = warc.read(spark, str(tmp_path))
    got = {(r.transaction, r.request.record_id, r.response.record_id, r.metadata.record_id) for r in warc.assemble(records).collect()}
    assert got == {("<q1>", "<q1>", "<r1>", "<m1>"), ("<q2>", "<q2>", "<r2>", "<m2>"), ("<alone>", "<alone>", None, None)}
    assert {bytes(r.payload) for r in records.collect()} == {f"{x}\r\n".encode() for x in ("m1", "r1", "q1", "m2", "r2", "q2", "alone")}
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(first[0][:-9]))
    with pytest.raises(Exception, match="ends within a record"):
        warc.read(spark, str(tmp_path)).count()


def test_warc_files_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 4)
    path = fresh_path(spark, "test-warc")
    warc.write(spark.createDataFrame([(*r, "x") for r in PAGES], SCHEMA).coalesce(1), path)
    assert spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).count() >= 7
    assert warc.assemble(warc.read(spark, path)).count() == len(PAGES)


# --- chat -----------------------------------------------------------------------------------------------------

CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", chat.EXAMPLE), (2, 1, "assistant", None), (2, 0, "system", "</turn>\n### User: x</turn>\n"), (3, 0, "=odd: role\n", "\\"), (3, 0, "assistant", "\\\\#"), (3, 0, "assistant", "\\\\#"),
    (None, 0, "User", "é🙂"), (None, None, None, "</turn"), (4, 0, "assistant", "</turn>" * 3 + "\\</turn>"), (5, 0, "assistant", ""), (6, 0, "Assistant", "not learned: role differs in case"), (7, 0, "ärger", "x"),
]
CHAT_SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def _plain_digests(rows):
    out = {}
    key = lambda x: (x is not None, x)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (key(r[1]), key(r[2]), key(r[3])))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("part_bytes", [1, 1 << 20])
def test_chat_round_trip(spark, part_bytes):
    df = spark.createDataFrame([(*r, 1) for r in CHATS], T.StructType([*CHAT_SCHEMA, T.StructField("formatted", T.IntegerType())]))
    dealt = chat.format_chats(df) if part_bytes > 1 else df.select("conv_id", "role", "text", "turn").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(lambda it: chat._format(it, 1), chat.PART)
    got = rows_of(dealt.mapInArrow(chat._read_back, chat.DIGESTS), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert got == _plain_digests(CHATS)
    if part_bytes == 1:
        assert dealt.where("part > 0").count() > 0


def test_chat_template_and_escapes():
    data, at, begin, end = chat.assemble(pa.array(["user", "assistant"]), pa.array(["a", chat.EXAMPLE]))
    assert data.tobytes() == b"### User: a</turn>\n### Assistant: \\\\\\#\\#\\# Assistant: \\</turn> ok</turn>\n"
    assert chat.unescape(data[begin[1] : end[1]].tobytes()).decode() == chat.EXAMPLE
    assert list(chat.parse(data.tobytes())) == [("user", "a"), ("assistant", chat.EXAMPLE)]
    with pytest.raises(ValueError):
        list(chat.parse(b"### User: a"))
    with pytest.raises(ValueError):
        list(chat.parse(b"a"))
    assert len(chat.assemble(pa.array([], pa.string()), pa.array([], pa.string()))[0]) == 0


def test_chat_buffer_is_the_column():
    """The assembled bytes are the column's value buffer; conversations may run over batches and parts."""
    turns = [(c, "assistant" if t % 2 else "user", f"{c}:{t} " + "é#" * (t % 7)) for c in range(40) for t in range(1 + c % 9)]
    kinds = pa.schema([("conv_id", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    whole = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*turns, strict=True), kinds, strict=True)], schema=kinds)
    want = chat.assemble(whole.column(1), whole.column(2))[0].tobytes()
    for step in (1, 7, 1000):
        for most in (0, 30, 1 << 20):
            out = list(chat._format((whole.slice(i, step) for i in range(0, len(whole), step)), most))
            assert b"".join(x for b in out for x in b.column(3).to_pylist()) == want and sum(sum(b.column(2).to_pylist()) for b in out) == len(turns)
            number = [(c, p) for b in out for c, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            assert number == sorted(set(number)) and (most < 1 << 20 or len(number) == 40)
            texts = [chat.unescape(x[a:z]).decode() for b in out for x, s, e in zip(*(b.column(k).to_pylist() for k in (3, 4, 5)), strict=True) for a, z in zip(s, e, strict=True)]
            assert texts == [t for _, r, t in turns if r == "assistant"]


def test_chat_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], CHAT_SCHEMA)).mapInArrow(chat._read_back, chat.DIGESTS).count() == 0


# --- mixing ---------------------------------------------------------------------------------------------------


def _plain_targets(sizes):
    weight = np.array([mixing.WEIGHTS[i % 3] for i in range(len(sizes))], float)
    sizes = np.array(sizes, float)
    cap, free, target = mixing.MOST * sizes, np.ones(len(sizes), bool), np.zeros(len(sizes))
    while free.any():
        target[~free] = cap[~free]
        target[free] = (sizes.sum() - cap[~free].sum()) * weight[free] / weight[free].sum()
        over = free & (target > cap)
        if not over.any():
            break
        free &= ~over
        target[~free] = cap[~free]
    return target


@pytest.mark.parametrize("sizes", [[10], [100, 1, 1], [1, 2, 3, 4, 500], [0, 10, 0], [5, 5, 5], [0]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in mixing.targets(df).orderBy("source").collect()]
    assert np.allclose(got, _plain_targets(sizes))


def test_flight_keeps_totals():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(0, 60))
        size, x = rng.integers(0, 50, n), rng.choice([0.0, 1.0, 0.3, 0.7, 0.5], n)
        out = mixing.flight(size, x, 3)
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert np.isclose(out.sum(), x.sum()) and np.isclose((size * out).sum(), (size * x).sum(), atol=1e-6)
        assert set(mixing.landing(size, out)) <= {0.0, 1.0}


def test_flight_keeps_expectation():
    size, x = np.array([1, 2, 3, 4, 5, 6, 7]), np.full(7, 0.4)
    mean = np.mean([mixing.flight(size, x, s) for s in range(4000)], 0)
    assert np.abs(mean - 0.4).max() < 0.04


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 20)  # several levels of blocks
    rows = [(i, prose(1 + i % 17, i), "en", "abcd"[min(i % 9, 3)]) for i in range(600)] + [(1000, None, "en", "a"), (1001, " ", "en", None), (1002, "x y", "en", None), (1003, "", "en", "z"), (5, "one two", "en", "d"), (5, "one two", "en", "d"), (None, "n", "en", "a")]
    df = documents(spark, rows)
    got = mixing.plan(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        s = by.setdefault(r.source, [r.source_size, r.target, 0, 0])
        s[2] += r.taken
        s[3] += r.size
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
    names = sorted((s for s in by if s is not None)) + [None]
    assert np.allclose([by[s][1] for s in names], _plain_targets([by[s][0] for s in names]))
    assert all(abs(t - k) <= 17 and size == seen for size, t, k, seen in by.values())
    assert {(r.doc_id, r.size, r.taken) for r in mixing.plan(df.repartition(5)).collect()} == {(r.doc_id, r.size, r.taken) for r in got}
    mixed = mixing.mix(df).collect()
    assert sum(len(WORD.findall(r.text or "")) for r in mixed) == sum(r.taken for r in got)
    assert mixed[0].asDict().keys() == set(df.columns)
    assert mixing.plan(df.where("doc_id < 0")).count() == 0


def test_landing_exchanges():
    """A large undecided document misses its total by thousands; exchanges of decided small ones make up for it."""
    rng = np.random.default_rng(5)
    size = np.concatenate(([5000], rng.integers(20, 400, 60)))
    x = np.concatenate(([0.4], rng.integers(0, 2, 60).astype(float)))
    want = float((size * x).sum())
    out = mixing.landing(size, x, np.ones(len(x), bool))
    assert set(out) <= {0.0, 1.0} and abs(float((size * out).sum()) - want) <= 20
    fixed = mixing.landing(size, x, np.arange(len(x)) == 0)
    assert (fixed[1:] == x[1:]).all()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mixing_reaches_targets(spark, sf):
    """On the whole table every source ends within its smallest document, or a hundredth (with ten documents: three), of its target."""
    by = {}
    rows = mixing.plan(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).collect()
    for r in rows:
        by.setdefault(r.source, [r.target, 0, 1 << 60])
        by[r.source][1] += r.taken
        if r.size:
            by[r.source][2] = min(by[r.source][2], r.size)
    assert all(abs(target - taken) <= max(least, target * (0.01 if sf == "sf0.01" else 0.03)) for target, taken, least in by.values())


def test_mixing_awkward_columns(spark):
    df = documents(spark, [(None, "a b c", "en", "s"), (None, "d e", "en", "s"), (None, "d e", "en", "s"), (1, "x " * 30, "en", "t"), (2, None, "en", "t")])
    clash = df.withColumns({"key": F.lit(1), "copies": F.lit(2), "row": F.lit(3), "size": F.lit(4), "jl_copies": F.lit(5), "a.b": F.lit(6)})
    rows = mixing.plan(clash).collect()
    assert len(rows) == 5 and len({r.key for r in rows if r.doc_id is None}) == 2
    mixed = mixing.mix(clash)
    assert mixed.columns == clash.columns
    assert sum(len(WORD.findall(r.text or "")) for r in mixed.collect()) == sum(r.taken for r in rows)
