import math
import random

from pyspark.sql import functions as F

from tessera.llm import topk


def brute(rows, k, asks):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in fine if asks(i)}:
        own = min(v for i, v in fine if i == q)
        got = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in fine if i != q)[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(got)}
    return out


def test_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(16)]) for i in range(300)]
    rows += [(i, list(rows[7][1])) for i in range(300, 340)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [float("inf")]), (404, [0.5]), (405, []), (None, [1.0]), (30, [0.0] * 16)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<double>, score int")
    for k in (1, 5):
        got = {tuple(r) for r in topk.search(df, F.col("vec_id") % 10 == 0, k).collect()}
        assert got == brute(rows, k, lambda i: i % 10 == 0)


def test_fewer_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 131072)]
    assert topk.search(df.where("false"), F.lit(True)).count() == 0


def test_thresholds_of_the_first_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 25)
    monkeypatch.setattr(topk, "BLOCK", 7)
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(i, [1.0, 0.0] * 4) for i in range(300, 330)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, shard string, theta double")
    for k in (1, 5, 400):
        got = {tuple(r) for r in topk.search(df, F.col("vec_id") % 10 == 0, k).collect()}
        assert got == brute(rows, k, lambda i: i % 10 == 0)
