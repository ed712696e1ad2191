import numpy as np
from pyspark.sql import functions as F

from shutterlake.llm import topk
from shutterlake.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, query_id string"


def brute(rows, k=5):
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in ok if i % 50 == 0}:
        own = min(v for i, v in ok if i == q)
        best = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in ok if i != q and len(v) == len(own))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def run(spark, rows, k=5, bins=16):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0, k, bins=bins).collect()}


def test_matches_brute_force_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 4], "x") for i in range(260)]
    rows += [(300, None, "x"), (350, [1.0, None, 1.0, 1.0], "x"), (301, [float("nan")] * 4, "x"), (302, [float("inf"), 0.0, 0.0, 0.0], "x"), (None, [1.0] * 4, "x"), (303, [], "x")]
    rows += [(400, [1.0, 2.0], "x"), (401, [-3.0, 0.0], "x"), (450, [9.0], "x")]
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_and_few_candidates(spark):
    rows = [(0, [1.0, -1.0], None), (0, [1.0, -1.0], None), (7, [0.5, 0.5], None), (7, [0.5, 0.5], None), (8, [-0.001, 0.3], None)]
    assert run(spark, rows) == {(0, 1, 7, 0), (0, 2, 7, 0), (0, 3, 8, -1 * 256 - 76 * 256)}


def test_no_queries_and_empty(spark):
    assert run(spark, [(1, [1.0], None), (2, [1.0], None)]) == set()
    assert run(spark, []) == set()


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0**40, 1.0], None), (1, [2.0**20, 1.0], None), (2, [2.0**20, 2.0], None), (3, [-(2.0**40), 0.0], None)]
    got = sorted(run(spark, rows))
    assert [x[2] for x in got] == [1, 2, 3]
    assert got[0][3] == got[1][3] == (1 << 63) - 1 and got[2][3] == -(1 << 63)


def test_many_waves_and_ties_beyond_what_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(topk, "WAVE", 2)
    rows = [(i, [float(i % 3)] * 4, "x") for i in range(420)] + [(500, [1.0, 2.0], "x"), (501, [3.0, 4.0], "x")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, k=300) == brute(rows, k=300)


def test_a_wave_sends_counts_and_not_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)], "x") for i in range(500)]
    frame = spark.createDataFrame(rows, SCHEMA).select(F.lit(8).alias("dim"), F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("vec"))
    blocks = topk._packed(frame, 64)
    asked = topk._wave(frame.filter("id % 50 = 0").orderBy("id"), 1024.0, 16)
    plan = blocks.mapInPandas(topk._histograms(spark.sparkContext.broadcast(asked), 16), "query_id long, bin int, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
    assert sum(r.n for r in plan.collect()) == 10 * 499  # every score but a query's with itself
    assert plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange") == 1
