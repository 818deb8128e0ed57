"""Nearest neighbours and wavelet files."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nightwarden.llm import ann, wavelet
from nightwarden.llm.registry import QUERIES, vocabulary


def exact(rows, ask, k):
    out = {}
    for i, q in rows:
        if ask(i):
            scored = sorted((-math.fsum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for i in want:
        assert [j for j, _ in got[i]] == [j for j, _ in want[i]]
        assert np.allclose([s for _, s in got[i]], [s for _, s in want[i]], rtol=1e-12, atol=1e-12)


def test_odd_vectors(spark):
    """Unusable vectors, repeated rows, ties among many equal vectors, few candidates."""
    nan, inf = float("nan"), float("inf")
    good = [(i, [1.0, 2.0, float(i % 3)]) for i in range(60)] + [(100 + i, [-3.0, float(i), 0.5]) for i in range(10)]
    bad = [(200, None), (201, []), (202, [0.0, 0.0, 0.0]), (203, [nan, 1.0, 1.0]), (204, [inf, 1.0, 1.0]), (205, [None, 1.0, 1.0]),
           (206, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    schema = "vec_id long, embedding array<double>, hash string, query string"
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in good + bad + good[:5]], schema)
    same(found(ann.search(df, F.col("vec_id") % 20 == 0)), exact(good, lambda i: i % 20 == 0, 20))
    few = spark.createDataFrame([(i, v, "x", "y") for i, v in good[:4]], schema)
    same(found(ann.search(few, F.col("vec_id") >= 0)), exact(good[:4], lambda i: True, 20))
    assert ann.search(df.limit(0), F.col("vec_id") >= 0).count() == 0
    assert ann.search(spark.createDataFrame([(i, v, "x", "y") for i, v in bad], schema), F.col("vec_id") >= 0).count() == 0


def test_recall_in_many_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 1.5, (3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(ann.search(df, F.col("vec_id") % 50 == 0, block=500, width=250))
    scores = x[::50] @ x.T
    hit = 0
    for n, i in enumerate(range(0, 3000, 50)):
        scores[n, i] = -np.inf
        hit += len({j for j, _ in got[i]} & set(np.argsort(-scores[n])[:20].tolist()))
        assert all(abs(s - x[i] @ x[j]) < 1e-9 for j, s in got[i])
    assert hit / (60 * 20) > 0.9


def test_equal_hashes_are_split():
    """Into equal parts, and into others in every tree."""
    ties = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 1000)
    cuts = ann._cuts(np.zeros((1000, 2), np.int64), ties, 4)
    parts = []
    for tree, (starts, seconds) in enumerate(cuts):
        assert (starts == 0).all()
        parts.append(np.searchsorted(seconds, ann._second(ties, tree), "right"))
        assert np.bincount(parts[-1]).tolist() == [250] * 4
    assert (parts[0] == parts[1]).mean() < 0.4


def recall(spark, x, step, **settings):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, hit, asked = found(ann.search(df, F.col("vec_id") % step == 0, **settings)), 0, range(0, len(x), step)
    for i in asked:
        scores = x @ x[i]
        scores[i] = -np.inf
        hit += len({j for j, _ in got[i]} & set(np.argsort(-scores)[:20].tolist()))
    return hit / (20 * len(asked))


def test_one_very_long_vector(spark):
    x = np.random.default_rng(2).normal(size=(4000, 16))
    x[17] *= 1000
    assert recall(spark, x, 80, block=600, width=300) > 0.9


def test_norms_of_every_size(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 8)) * np.exp2(rng.integers(-8, 8, (2000, 1)))
    x[:3] = [[1e-200] * 8, [1e200] * 8, [5e-324, *[0.0] * 7]]
    assert recall(spark, x, 100, block=300, width=150) > 0.9


def test_recall_on_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = exact(rows, lambda i: i % 20 == 0, 20)
    got = found(QUERIES["op4_hash_prefix_forest"](spark, sf_dir))
    assert sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want) / (20 * len(want)) >= 0.9


@pytest.mark.parametrize("seed", range(4))
def test_wavelet_round_trip(seed):
    draw = random.Random(seed)
    ids = np.array([min(int(draw.paretovariate(0.4)), 70_000 if seed else 9) for _ in range(draw.choice([1, 7, 512, 1500]))], np.uint32)
    lengths = np.array([len(ids)])
    matrix, sizes, docs = wavelet.from_bytes(wavelet.to_bytes(ids, lengths, np.array([wavelet.NO_ID])))
    assert (matrix.ids() == ids).all() and list(sizes) == [len(ids)] and list(docs) == [wavelet.NO_ID]
    at = np.arange(len(ids))
    assert (matrix.access(at) == ids).all()
    for symbol in {*ids[:20].tolist(), 3, 1 << 25}:
        where = np.flatnonzero(ids == symbol).tolist()
        assert matrix.occurrences(symbol) == where and matrix.rank(symbol) == len(where)
        assert all(matrix.rank(symbol, end) == sum(w < end for w in where) for end in (0, 1, len(ids) // 2, len(ids)))
    with pytest.raises(IndexError):
        matrix.select(1 << 25, 0)
    with pytest.raises(ValueError):
        wavelet.from_bytes(b"none of it")


def test_files(spark, odd, empty, tmp_path):
    plain = Tokenizer.from_file(vocabulary())
    folder = str(tmp_path / "files")
    files = wavelet.write(odd.repartition(3), vocabulary(), 2, shard_tokens=500, folder=folder)
    assert files.count() > 3
    got = wavelet.read(files, folder).orderBy("start").collect()
    want = []
    for d in odd.collect():
        ids = np.array(plain.encode(d["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((d["doc_id"], len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == sorted(want, key=repr)
    key = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert key == sorted(key)
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    assert wavelet.read(wavelet.write(empty, vocabulary(), 2, folder=folder), folder).count() == 0
