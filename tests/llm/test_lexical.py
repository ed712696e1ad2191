import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from shutterlake.llm import lexical
from shutterlake.llm.lexical import _Batch, index, search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    held = [(i, Counter(split(t))) for i, t, *_ in docs if split(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text, *_ in items:
        rows = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            score = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in split(text) if c[t])
            if score > 0:
                rows.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(rows, key=lambda r: (r[0], r[1], r[2] or 0))[:k], 1)]
    return Counter(out)


def run(spark, docs, items, k=10, width=lexical.WIDTH):
    d = spark.createDataFrame(docs, "doc_id long, text string, term string, n string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string, query string").repartition(2)
    return Counter(tuple(r) for r in search(index(d, width=width), q, k, width=width).collect())


def corpus(n, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(f"W{x}" for x in rng.zipf(1.4, rng.integers(1, 60)) % 300), "x", None) for i in range(n)]


def test_terms():
    assert terms_of("A-b_c Éa x1\x7f\x00Z K".encode()) == [t.encode() for t in split("A-b_c Éa x1\x7f\x00Z K")]
    assert terms_of(None) == []


@pytest.mark.parametrize("width", [16, 4096])
def test_matches_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 32)
    monkeypatch.setattr(lexical, "TERMS", 40)  # several batches, one of a single long query
    docs = corpus(300) + [(900, None, "", ""), (901, "", "", ""), (902, " .,;\n", "", ""), (None, "w1 w2 w3", "", ""), (5, "w1 w2 w3", "", ""), (5, "w1 w2 w3", "", ""), (903, "w7 " * 400 + "été", "", "")]
    items = [(i, d[1], "") for i, d in enumerate(corpus(9, 5))] + [(50, None, ""), (51, "", ""), (52, "nowhere", ""), (53, "w1 W1 w3 w2", ""), (53, "w1 W1 w3 w2", ""), (None, "ÉTÉ été", ""), (54, " ".join(f"w{i}" for i in range(200)), "")]
    assert run(spark, docs, items, width=width) == brute(docs, items)


def test_ties_and_few(spark):
    docs = [(i, "same text here", "", "") for i in range(40, 0, -1)] + [(99, "other", "", "")]
    items = [(1, "same", ""), (2, "other text", "")]
    got = run(spark, docs, items)
    assert got == brute(docs, items) and [x[2] for x in sorted(got) if x[0] == 1] == list(range(1, 11))


def test_empty(spark):
    assert run(spark, [], [(1, "a", "")]) == Counter() == run(spark, corpus(3), []) == run(spark, [], [])


def test_bounds_are_never_below_scores():
    rows = [(q, f"w{t}".encode(), w) for q, t, w in ((1, 1, 7000), (1, 2, 10), (2, 2, 10), (2, 3, 999))]
    batch = _Batch(rows, 4)
    for times in ([1, 1, 1], [300, 2, 1], [254, 255, 256]):
        sketch = np.zeros(4, np.uint8)
        np.maximum.at(sketch, [lexical.crc32(f"w{t}".encode()) % 4 for t in (1, 2, 3)], np.minimum(times, 255).astype(np.uint8))
        exact = batch.scores(b"w1 w2 w3", np.array(times, "<u4").tobytes(), 60)
        assert (batch.bounds(sketch[None], np.array([60]))[0] >= exact).all()


def test_sql(spark, tmp_path):
    import duckdb

    spark.createDataFrame([d[:2] for d in corpus(80)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([d[:2] for d in corpus(7, 3)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(con.execute(lexical.SQL).fetchall()) == sorted(map(tuple, lexical.op12_lexical_search(spark, str(tmp_path)).collect()))
