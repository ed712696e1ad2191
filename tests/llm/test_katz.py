import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shutterlake.llm import katz
from shutterlake.llm.katz import CUTOFF, good_turing, katz_scores


def brute(rows, order=2):
    """Plain dictionaries, and recursion from the order's n-gram down to the unseen word."""
    docs = [(i, t, [*(x.decode() for x in (s or "").encode().lower().split()), "\n"]) for i, s, t in rows]
    seen = [Counter() for _ in range(order)]  # n-grams by order, texts padded with start marks
    for _, train, ws in docs:
        if train:
            for k, own in enumerate(seen):
                padded = ["<s>"] * k + ws
                own.update(tuple(padded[i : i + k + 1]) for i in range(len(ws)))
    uni = seen[0]
    n, v = sum(uni.values()), len(uni)
    d = [good_turing([0, *[sum(x == r for x in c.values()) for r in range(1, CUTOFF + 2)]]) for c in seen]
    used = sum(d[0][min(c, CUTOFF + 1)] * c for c in uni.values())
    scale = 1.0 if used < n - 1e-9 else n / (n + 1)
    unseen = 1 - scale * used / n if n else 1.0
    after = [defaultdict(dict) for _ in seen]
    for k, own in enumerate(seen):
        for gram, c in own.items():
            after[k][gram[:-1]][gram[-1]] = c
    weights = {}

    def p(h, w):
        k = len(h)
        if not k:
            return scale * d[0][min(uni[w,], CUTOFF + 1)] * uni[w,] / n if uni[w,] else unseen
        if h not in after[k]:
            return p(h[1:], w)
        if h not in weights:
            total = sum(after[k][h].values())
            star = {x: d[k][min(c, CUTOFF + 1)] * c / total for x, c in after[k][h].items()}
            if 1 - sum(star.values()) < 1e-12:
                star = {x: y * total / (total + 1) for x, y in star.items()}
            weights[h] = star, (1 - sum(star.values())) / (1 - sum(p(h[1:], x) for x in star))
        star, a = weights[h]
        return star[w] if w in star else a * p(h[1:], w)

    for h in after[-1]:
        assert math.isclose(sum(p(h, w) for (w,) in uni) + p(h, "\0new"), 1, rel_tol=1e-9)
    out = Counter()
    for i, train, ws in docs:
        base = sum(math.log10((uni[w,] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        padded = ["<s>"] * (order - 1) + ws
        score = sum(math.log10(p(tuple(padded[j : j + order - 1]), w)) for j, w in enumerate(ws))
        out[i, not train, len(ws), sum(uni[w,] > 0 for w in ws), n, round(base, 6), round(score, 6)] += 1
    return out


def run(spark, rows, order=2):
    df = spark.createDataFrame([(i, s, t, "x") for i, s, t in rows], "doc_id long, text string, learn boolean, block string").repartition(3)
    got = katz_scores(df, F.col("learn"), order=order)[0].collect()
    return Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got)


def texts(n=150):
    pool = [f"w{int(60 * ((i * 7919 % 101) / 101) ** 3)}" for i in range(101)]
    for i in range(n):
        yield i, " ".join(pool[(i * i + j * j * 3 + i * j) % 101] for j in range(i % 23)), i % 5 != 1


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_match_brute_force_with_exact_normalisation(spark, order):
    rows = [*texts(), (None, "w1 W2\tNEW\nnew", False), (500, None, True), (501, "", False), (7, "w0 w0", True), (7, "w0 w0", True), (502, "É é \x1c\x85 a", True), ((1 << 60) + 1, "w3 never seen before w0", False), (600, "w0 " * 3000, True)]
    assert run(spark, rows, order) == brute(rows, order)


@pytest.mark.parametrize("order", [2, 3])
def test_hot_histories_many_blocks_and_partitions_change_nothing(spark, monkeypatch, order):
    monkeypatch.setattr(katz, "BLOCK", 700)
    monkeypatch.setattr(katz, "SHARE", 60)
    monkeypatch.setattr(katz, "HOT", 8)
    rows = [(i, "the " + " the ".join(f"x{i * k % 97}" for k in range(1, 40)), i % 5 != 1) for i in range(60)]
    assert run(spark, rows, order) == brute(rows, order)


def test_counts_beyond_32_bits_are_kept():
    """A word seen 2^33 times: what a block asks with and what its probability is are of that count."""
    big, n = 1 << 33, [0, 10, 4, 3, 2, 1, 1]
    unigrams = katz.Unigrams.of(2 * big, 3, n)
    row = type("Row", (), {"local": katz.pack(np.array([0, 1], np.uint32)), "lengths": katz.pack(np.array([2], np.uint32)), "train": katz.pack(np.array([1], np.uint8))})
    told = pd.DataFrame({"level": [1], "part": [0], "offset": [0], "a": [katz.pack(np.array([0, 1], np.uint32))], "b": [katz.pack(np.array([big, 5], np.uint64))]})
    block = katz.Block(row, told, unigrams, 7, 1 << 40, 5)
    assert math.isclose(block.p[0], 0.5)
    block.ask()
    i = int(np.nonzero(block.key_word == 0)[0][0])
    assert katz.unpack(katz.pack(block.key_prior), "<u8")[i] == big and block.h_count.tolist() == [7, big]
    asked = pd.DataFrame({"part": [0], "block": [0], "heads": [katz.pack(block.key_head)], "words": [katz.pack(block.key_word)], "train": [katz.pack(block.train_counts)], "prior": [katz.pack(block.key_prior)], "hot": [katz.pack(np.zeros(0, np.uint64))]})
    assert katz.unpack(asked["prior"][0], "<u8").max() == big


def test_nothing_to_learn_from_and_empty(spark):
    rows = [(1, "a b", False), (2, None, False)]
    assert run(spark, rows) == Counter({(1, True, 3, 0, 0, 0.0, 0.0): 1, (2, True, 1, 0, 0, 0.0, 0.0): 1})
    assert run(spark, []) == Counter()


def test_packed_arrays_come_back():
    for a in (np.arange(1000, dtype=np.uint64) ** 3, np.zeros(0, np.uint32), np.array([1.5, -2.0])):
        assert (katz.unpack(katz.pack(a), a.dtype.str) == a).all()
