import math
from collections import Counter, defaultdict
from hashlib import md5

from shutterlake.llm.mixing import measured, mix, mixed


def filled(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    """Targets by repeated resharing of what is over the caps."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    goal, total = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in goal]
        left = total - sum(goal.values())
        own = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if own[s] >= repeats * sizes[s]]
        if not over:
            return goal | own
        goal |= {s: repeats * sizes[s] for s in over}


def test_targets_and_takes(spark):
    rows = [(i, ("a", "b", None, "z", "é")[min(4, i % 9)], " ".join(["word"] * (i * 37 % 50))) for i in range(900)]
    rows += [(5000, "a", None), (5001, "tiny", "one"), (5002, "none", ""), (5003, "b", "!!! ### 12")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, size int").repartition(4)
    for buckets in (4096, 3):
        out = mixed(measured(df), buckets=buckets).collect()
        sizes, took = defaultdict(int), Counter()
        for _, s, t in rows:
            sizes[s] += len((t or "").split())
        goal = filled(sizes)
        for r in out:
            took[r.source] += r.taken
            assert r.source_size == sizes[r.source] and math.isclose(r.target, goal[r.source], rel_tol=1e-9)
            assert r.taken in (0, r.size, 2 * r.size)
        assert len(out) == len(rows)
        assert all(abs(took[s] - goal[s]) <= 25 for s in sizes)
        if buckets == 4096:
            first = {r.doc_id: r.taken for r in out}
    assert first == {r.doc_id: r.taken for r in out}


def test_order_is_by_exponential_keys(spark):
    rows = [(i, "a", "x y") for i in range(200)] + [(1000 + i, "b", "x y") for i in range(600)]
    out = mixed(measured(spark.createDataFrame(rows, "doc_id long, source string, text string"))).filter("source = 'b'").collect()
    u = lambda i: (int(md5(str(i).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    order = sorted(out, key=lambda r: -math.log(u(r.doc_id)))
    takes = [r.taken for r in order]
    assert takes == sorted(takes, reverse=True) and len(set(takes)) == 2


def test_stage_repeats_rows_and_edge_cases(spark):
    df = spark.createDataFrame([(1, "a", "x y"), (1, "a", "x y"), (None, None, "z"), (3, "a", None)], "doc_id long, source string, text string")
    out = mix(df)
    assert out.columns == df.columns
    assert sum(len(r.text.split()) for r in out.collect()) in (6, 7, 8)
    assert mixed(measured(df.limit(0))).count() == 0 and mix(df.limit(0)).count() == 0
    assert [r.taken for r in mixed(measured(df.filter("text is null"))).collect()] == [0]


def test_a_very_long_text(spark):
    """One text of two million words among short ones: sizes are whole, no document is taken over twice, reruns agree."""
    rows = [(0, "a", "word " * 2_000_000)] + [(i, "ab"[i % 2], "one two three " * (i % 9 + 1)) for i in range(1, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    out = {r.doc_id: r for r in mixed(measured(docs)).collect()}
    assert out[0].size == 2_000_000 and len(out) == 300
    assert all(0 <= r.taken <= 2 * r.size for r in out.values())
    b = [r for r in out.values() if r.source == "b"]
    assert abs(sum(r.taken for r in b) - b[0].target) <= max(r.size for r in b)
    assert {k: r.taken for k, r in out.items()} == {r.doc_id: r.taken for r in mixed(measured(docs)).collect()}
