"""Near-duplicates, substrings, embeddings, components and the pipeline against brute force."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinloom.llm import components, embeddings, minhash, substrings

from .helpers import WORD, documents, prose, rows_of


def union(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(5, 5), (3, 1), (1, 3), (9, 7)], [(i, (i * 7) % 50) for i in range(50)]])
def test_components(spark, edges):
    n = 80
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.v: r.root for r in components.components(df).collect()}
    assert [got.get(i, i) for i in range(n)] == union(n, edges)


# --- texts ----------------------------------------------------------------------------------------------------


def _changed(text, k, seed):
    rng = random.Random(seed)
    words = text.split(" ")
    for _ in range(k):
        words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
    return " ".join(words)


def _similar(texts):
    """Pairs of weighted Jaccard of at least 0.8, with idf over exact counts."""
    sets = []
    for t in texts:
        w = WORD.findall(t or "")
        sets.append(collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter())
    df = collections.Counter(k for s in sets for k in s)
    idf = {k: 1 + 0.2 * math.log(1 / max(n / len(texts), 0.001)) / math.log(1000) for k, n in df.items()}
    weight = [{k: c * idf[k] for k, c in s.items()} for s in sets]
    out = []
    for a in range(len(texts)):
        for b in range(a):
            low = sum(min(w, weight[b][k]) for k, w in weight[a].items() if k in weight[b])
            if low and low / (sum(weight[a].values()) + sum(weight[b].values()) - low) >= minhash.SIMILARITY:
                out.append((b, a))
    return out


def test_minhash(spark):
    base = [prose(120, s) for s in range(12)]
    texts = base + [_changed(base[k % 4], 1 + k % 5, k) for k in range(24)] + [base[5]] * 5 + ["a b", "a b", "a  b", "x", None, None, "", " \n", "word " * 300, "word " * 301]
    got = rows_of(minhash.classes(documents(spark, list(enumerate(texts))).withColumnRenamed("source", "digest")), "doc_id", "class_id", "kept")
    expected = union(len(texts), _similar(texts))
    assert [got[i][0] for i in range(len(texts))] == expected
    assert all(got[i][1] == (got[i][0] == i) for i in got)


def test_minhash_large_groups(spark, monkeypatch):
    """Salted buckets: a group of near copies and a group of exact copies, each far above the salt."""
    monkeypatch.setattr(minhash, "SALT", 20)
    monkeypatch.setattr(minhash, "HUB", 16)
    base, other = prose(200, 77), prose(200, 78)
    texts = [_changed(base, 1, k) for k in range(150)] + [other] * 150 + [prose(100, 100 + k) for k in range(40)]
    got = rows_of(minhash.classes(documents(spark, list(enumerate(texts)), 6)), "doc_id", "class_id", "kept")
    assert {got[i][0] for i in range(150)} == {0} and {got[i][0] for i in range(150, 300)} == {150} and all(got[i][1] for i in range(300, 340))


def test_minhash_awkward_rows(spark):
    df = documents(spark, [(None, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (3, "")])
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in minhash.classes(df).collect()), key=str)
    assert got == sorted([(None, None, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True), (3, 3, True)], key=str)
    assert sorted((r.doc_id for r in minhash.dedup(df).collect()), key=str) == sorted([None, 1, 3], key=str)
    assert minhash.classes(df.where("doc_id < 0")).count() == 0


def test_minhash_clashing_columns_and_repeated_ids(spark):
    """Rows that share a doc_id with different texts both stay; copies of either are found; columns may have any name."""
    one, two, three = (prose(60, 40 + k) for k in range(3))
    df = documents(spark, [(5, one), (5, two), (7, two), (8, _changed(one, 1, 3)), (9, three), (9, three), (3, _changed(two, 1, 5))])
    clash = df.withColumns({c: F.lit(1) for c in ("id", "jl_gone", "samples", "key", "class_id", "kept", "a.b")})
    kept = minhash.dedup(clash)
    assert kept.columns == clash.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(3, _changed(two, 1, 5)), (5, one), (9, three)])
    got = sorted((r.doc_id, r.class_id, r.kept) for r in minhash.classes(clash).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (7, 3, False), (8, 5, False), (9, 9, True), (9, 9, True)]
    again = documents(spark, [(5, one), (5, two), (9, three), (9, three)])
    assert sorted((r.doc_id, r.text) for r in minhash.dedup(again).collect()) == sorted([(5, one), (5, two), (9, three)])


def test_minhash_long_texts(spark):
    """Texts above the size of a piece, one a near copy of the other."""
    one = prose(200_000, 31)
    rows = [(1, one), (2, _changed(one, 4000, 1)), (3, prose(200_000, 32)), (4, prose(50, 33))]
    assert len(one) > 1 << 20
    got = rows_of(minhash.classes(documents(spark, rows)), "doc_id", "class_id")
    assert got == {1: (1,), 2: (1,), 3: (3,), 4: (4,)}


def test_recall_at_the_threshold(spark):
    """Pairs just above 0.8, with the production parameters and with all pairs that meet verified."""
    rows, pairs = [], 0
    for k in range(150):
        base = prose(200, 5000 + k)
        words = base.split(" ")
        for i in range(20, 200, 50):  # each changes five of 196 shingles: about 0.81
            words[i] = f"x{k}"
        rows += [(2 * k, base), (2 * k + 1, " ".join(words))]
    exact = {b for a, b in _similar([t for _, t in rows])}
    assert len(exact) >= 100
    for agree in (minhash.AGREE, 0):
        got = rows_of(minhash.classes(documents(spark, rows), agree=agree), "doc_id", "class_id")
        found = sum(got[b] == (b - 1,) for b in exact)
        assert found >= 0.97 * len(exact), (found, len(exact))
        assert all(got[i] == (i,) for i, _ in rows if i not in exact)


def test_samples_agree_with_similarity():
    """The share of equal samples estimates the weighted Jaccard."""
    rng = np.random.default_rng(4)
    f = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    w = rng.uniform(0.5, 9, len(f)).astype(np.float32)
    v = np.where(np.arange(len(f)) % 5 == 0, w * 0.2, w).astype(np.float32)
    agreed = []
    for _ in range(40):
        f = np.sort(rng.integers(0, 2**63, len(w)).astype(np.uint64))
        a, b = (minhash.sample(f, x, np.array([0, len(f)])) for x in (w, v))
        agreed.append(float((a == b).mean()))
    assert abs(np.mean(agreed) - minhash.weighted_jaccard(f, w, f, v)) < 0.04


# --- substrings -----------------------------------------------------------------------------------------------


def _plain_spans(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        covered = np.zeros(len(data), bool)
        for i in range(len(data) - substrings.LENGTH + 1):
            s = data[i : i + substrings.LENGTH]
            if s in seen:
                covered[i : i + substrings.LENGTH] = True
            seen.add(s)
        n_spans = int((np.diff(np.append(0, covered.astype(int))) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~covered].tobytes()
        out[doc] = (len(data), int(covered.sum()), n_spans, hashlib.sha256(kept).hexdigest())
    return out


def test_substrings(spark):
    rng = random.Random(6)
    shared = [prose(40, s) for s in range(6)]
    rows = [(k, "".join(rng.choice([rng.choice(shared), prose(rng.randint(1, 30), 1000 + k), "é漢" * 40, "=" * rng.randint(90, 240)]) for _ in range(rng.randint(0, 6)))) for k in range(80)]
    rows += [(200, None), (201, ""), (202, "x" * 99), (203, "x" * 99), (204, "y" * 100), (205, "y" * 100), (206, "ab" * 300), (207, "z" + shared[0][:99]), (208, shared[0][-100:] + "q"), (-3, shared[1] + shared[1])]
    got = rows_of(substrings.spans(documents(spark, rows, 5).withColumnRenamed("lang", "rank")), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    expected = _plain_spans(rows)
    assert sum(x[1] for x in expected.values()) > 5000
    assert got == expected


def test_substrings_hot_anchors(spark, monkeypatch):
    """A line in all texts, whole and in changing surroundings: its anchors are at more than HOT places."""
    monkeypatch.setattr(substrings, "HOT", 5)
    line, rng = prose(30, 5), random.Random(8)
    rows = [(k, f"{prose(rng.randint(0, 12), 300 + k % 40)}\n{line}\n{prose(rng.randint(0, 12), 500 + k % 30)}") for k in range(120)] + [(500, line * 3), (501, line), (502, line), (503, "abcde" * 100)]
    got = rows_of(substrings.spans(documents(spark, rows, 7)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == _plain_spans(rows)


def test_substrings_long_text(spark):
    """Texts above the size of a piece, repeating themselves and each other."""
    one = prose(200_000, 21)
    assert len(one) > 1 << 20
    rows = [(1, one), (2, "x" + one[300_000:] + prose(50, 3)), (3, prose(40, 4))]
    got = rows_of(substrings.spans(documents(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans")
    assert got[1][1:] == (0, 0) and got[3][1:] == (0, 0) and got[2][1:] == (len(one) - 300_000, 1)


def test_substrings_awkward_rows(spark):
    long = prose(60, 1)
    df = documents(spark, [(1, long), (1, long), (None, long), (2, long)])
    got = sorted(((r.doc_id, r.n_removed) for r in substrings.spans(df).collect()), key=str)
    n = len(long.encode())
    assert got == sorted([(None, 0), (1, n), (1, n), (2, n)], key=str)
    assert substrings.spans(df.where("doc_id > 5")).count() == 0


# --- embeddings -----------------------------------------------------------------------------------------------

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("bucket", T.IntegerType())])


def _plain_links(vectors):
    x = np.array(vectors, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T >= embeddings.THRESHOLD
    np.fill_diagonal(s, False)
    return s


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", 16)
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(12, 48))
    vectors = [c + rng.normal(size=48) * s for c in centers for s in (0.05, 0.1, 0.2, 0.25, 0.3)] + [centers[0]] * 6 + [centers[1] + rng.normal(size=48) * 0.08 for _ in range(60)] + list(rng.normal(size=(100, 48)))
    order = rng.permutation(len(vectors))
    vectors = [vectors[i].astype(np.float32).tolist() for i in order]
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    bad = [(1000, None, 0), (1001, [0.0] * 48, 0), (1002, [float("nan")] + [1.0] * 47, 0), (1003, [None] + [1.0] * 47, 0), (1004, [float("inf")] * 48, 0), (1005, [], 0), (None, vectors[0], 0)]
    got = rows_of(embeddings.near_duplicates(spark.createDataFrame(rows + bad, VECTORS).repartition(4)), "vec_id", "n_links", "component_id", "kept")
    s = _plain_links(vectors)
    found = sum(got[i][0] for i in range(len(vectors)))
    assert 0.97 * s.sum() <= found <= s.sum() and all(got[i][0] <= s[i].sum() for i in range(len(vectors)))
    a, b = np.nonzero(np.triu(s))
    roots = union(len(vectors), list(zip(a.tolist(), b.tolist(), strict=True)))
    assert np.mean([got[i][1] == roots[i] for i in range(len(vectors))]) > 0.97
    assert all(got[i] == (0, i, True) for i in range(1000, 1006)) and got[None] == (0, None, False)


def test_embeddings_far_range_and_empty(spark):
    rows = [(1, [1e-38, 0.0, 1e-38], 0), (2, [2e38, 0.0, 2e38], 0), (3, [0.0, 1.0, 0.0], 0), (4, [1.0], 0), (5, [-0.0, 3.0], 0)]
    got = rows_of(embeddings.near_duplicates(spark.createDataFrame(rows, VECTORS)), "vec_id", "n_links", "component_id", "kept")
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (1, 3, True), 4: (0, 4, True), 5: (1, 3, False)}
    assert embeddings.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def _at_cosine(n, d, cosine, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cosine = np.broadcast_to(cosine, n)[:, None]
    return x, cosine * x + np.sqrt(1 - cosine**2) * u


@pytest.mark.parametrize("d", [64, 100, 128, 256, 768])
def test_recall_near_the_threshold(d):
    """Pairs at cosine 0.9 exactly, the hardest ones, at any dimension."""
    x, y = _at_cosine(1500, d, 0.9, 1)
    p, q = embeddings.hashes(x), embeddings.hashes(y)
    met = (p == q[:, :1]).any(1) | (q == p[:, :1]).any(1)
    near = np.bitwise_count(embeddings.signs(x) ^ embeddings.signs(y)).sum(1) <= embeddings.most_apart(0.9)
    assert near.mean() > 0.998 and (met & near).mean() >= 0.92, (near.mean(), met.mean())


def test_recall_end_to_end(spark):
    """Pairs at 0.9 to 0.95 planted in a copy of the given table."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    own = np.array([r.embedding for r in table.collect()])
    _, y = _at_cosine(300, own.shape[1], 0.0, 3)
    x = own[:300] / np.linalg.norm(own[:300], axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = np.linspace(0.9001, 0.95, 300)[:, None]
    planted = [(100_000 + i, v.tolist(), 0) for i, v in enumerate((c * x + np.sqrt(1 - c**2) * y).astype(np.float32))]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(own.astype(np.float32))] + planted
    got = rows_of(embeddings.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(4)), "vec_id", "n_links", "component_id")
    s = _plain_links([r[1] for r in rows])
    assert s.sum() >= 600
    found, there = sum(n for n, _ in got.values()), int(s.sum())
    assert 0.93 * there <= found <= there
    assert np.mean([got[100_000 + i][1] == i for i in range(300)]) >= 0.9


@pytest.mark.parametrize("chunk", [7, 4096])
def test_links_count_once_for_both(spark, monkeypatch, chunk):
    """Counts are those of the pairs that meet, whoever asks, and don't depend on chunks."""
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    x, y = _at_cosine(80, 32, np.linspace(0.85, 0.99, 80), 5)
    vectors = np.concatenate((x, y)).astype(np.float32)
    got = rows_of(embeddings.near_duplicates(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], VECTORS).repartition(3)), "vec_id", "n_links")
    unit = embeddings._units(vectors)
    p = embeddings.hashes(unit)
    met = (p[:, None, :] == p[None, :, :1]).any(2)
    few = np.bitwise_count(embeddings.signs(unit)[:, None] ^ embeddings.signs(unit)[None]).sum(2) <= embeddings.most_apart(0.9)
    links = _plain_links(vectors) & (met | met.T) & few
    assert [got[i][0] for i in range(160)] == links.sum(1).tolist()


# --- pipeline -------------------------------------------------------------------------------------------------


def test_pipeline_on_awkward_rows(spark, data):
    import corpus_pipeline

    base = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    odd = documents(spark, [(None, None, None, None), (9001, "", None, "s"), (9002, "12 34", "en", None), (9003, prose(40, 1) + " password = abcdefgh1234", None, "s"), (9003, prose(40, 1) + " password = abcdefgh1234", None, "s")])
    docs = base.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, data)
        if name != "tokens":
            assert docs.columns == columns
    assert docs.count() > 0 and {"n_tokens", "ids_sha256", "decoded_sha256"} <= set(docs.columns)
    empty = documents(spark, [(1, "a")]).where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, data)
    assert empty.count() == 0


def test_pipeline_against_plain_forms(spark):
    """What each stage keeps, row by row, against plain forms of its operator."""
    import public_tokenizers
    import tiktoken

    import corpus_pipeline
    from joinloom.llm import mixing

    latin, greek = "etaoinshrdlu", "αβγδεζηθικλμ"
    clean = [(i, prose(80 + i % 9, i, latin), "aa", f"s{i % 3}") for i in range(90)] + [(100 + i, prose(80, 300 + i, greek), "bb", "s1") for i in range(40)]
    near = [(200 + k, _changed(clean[k][1], 1, k), "aa", "s2") for k in range(12)] + [(220, clean[5][1], "aa", "s0"), (221, clean[5][1], "aa", "s0"), (1, clean[1][1], "aa", "s1")]
    secret = [(300, prose(60, 900, latin) + " password=abcdefgh12 tail", "aa", "s0"), (301, prose(60, 901, latin) + " " + "0123456789abcdef" * 3, "aa", "s1")]
    odd = [(400, "абв где жзи " * 30, None, "s0"), (401, None, "aa", "s0"), (402, "12 34 --", "aa", "s0"), (403, prose(30_000, 77, latin), "aa", None)]
    docs, seen = documents(spark, clean + near + secret + odd, 5), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, "").persist()
        seen[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == before.columns
    ids = lambda name: sorted(r.doc_id for r in seen[name])
    # language: what isn't in a learned language goes, clean documents stay
    assert ids("language") == sorted(r[0] for r in clean + near + secret + odd[3:])
    # near-duplicates: by all pairs
    rows = sorted((r.doc_id, r.text) for r in seen["language"])
    roots = union(len(rows), _similar([t for _, t in rows]) + [(i, i + 1) for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0]])
    assert ids("near_duplicates") == sorted({rows[r][0] for r in roots}) and len(ids("near_duplicates")) == len(clean) + len(secret) + 1
    # secrets: the texts as they were but for the spans
    was = {r.doc_id: r.text for r in seen["near_duplicates"]}
    for r in seen["secrets"]:
        want = was[r.doc_id].replace("password=abcdefgh12", "[ASSIGN]").replace("0123456789abcdef" * 3, "[HEX]")
        assert r.text == want and r.n_chars == len(want)
    # mixture: whole rows, so often that each source comes near its target and no document beyond three times
    taken = collections.Counter((r.doc_id, r.text, r.source) for r in seen["mixture"])
    there = {(r.doc_id, r.text, r.source) for r in seen["secrets"]}
    assert set(taken) <= there and max(taken.values()) <= mixing.MOST
    size = collections.Counter()
    for _, t, s in there:
        size[s] += len(WORD.findall(t))
    names = sorted(x for x in size if x is not None) + [None]
    cap, free, target = {x: 3 * size[x] for x in names}, set(names), {}
    weight = {x: (1, 2, 3)[i % 3] for i, x in enumerate(names)}
    while free:
        level = (sum(size.values()) - sum(cap[x] for x in names if x not in free)) / sum(weight[x] for x in free)
        over = {x for x in free if cap[x] < level * weight[x]}
        target = {x: min(cap[x], level * weight[x]) for x in names}
        if not over:
            break
        free -= over
    got = collections.Counter()
    for (_, t, s), n in taken.items():
        got[s] += n * len(WORD.findall(t))
    assert all(abs(got[x] - target[x]) <= 90 for x in names if x is not None), (got, target)
    # tokens: by the tokenizer itself
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    theirs = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = collections.Counter(r.text for r in seen["mixture"])
    assert collections.Counter(tuple(r.token_ids) for r in seen["tokens"]) == collections.Counter({tuple(theirs.encode_ordinary(t)): n for t, n in texts.items()})


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
