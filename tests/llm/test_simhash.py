import numpy as np
import xxhash

from shutterlake.llm.simhash import DRAWS, SAMPLES, fingerprint_links, keep_one, near_duplicates, sample_prints_udf
from shutterlake.operators.components import connected_components


def fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def components(prints):
    """Brute force over all pairs: {row: least id}."""
    ids = list(range(len(prints)))
    parent = ids[:]

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids[:i]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in ids]


def test_query_form_matches_brute_force(spark):
    base = [f"w{i % 7} the Quick brown\tfox number{i} jumps over lazy dogs again and again number{i * 3}" for i in range(40)]
    texts = base + [t + " x" for t in base[:10]] + [t.upper() for t in base[5:9]] + [None, "", " \n ", "One", "one", "two Words", "é È é", "word " * 5000]
    df = spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(texts)], "doc_id long, text string, fp string, component long").repartition(5)
    prints = [fingerprint(t) for t in texts]
    want = {(i, f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, components(prints)))}
    assert {tuple(r) for r in near_duplicates(df).collect()} == want


def test_links_connect_all_within_radius_even_in_a_hot_key(spark):
    rng = np.random.default_rng(3)
    seeds = [int(x) for x in rng.integers(0, 2**63, 6)]
    prints = {s ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for s in seeds for _ in range(60)}
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    got = {r[0] % (1 << 64): r[1] % (1 << 64) for r in connected_components(fingerprint_links(df, chunk=16)).collect()}
    want = components(prints)
    pairs = [(i, j) for i in range(len(prints)) for j in range(i)]
    assert all((got.get(prints[i], prints[i]) == got.get(prints[j], prints[j])) == (want[i] == want[j]) for i, j in pairs)


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "only null here zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 3), (None, 3), (3, 3), (3, 3), (None, None)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def test_stage_keeps_one_row_of_each_group(spark):
    words = " ".join(f"w{i}" for i in range(200))
    rows = [(1, words, "en"), (2, words, "en"), (None, words, None), (4, "something else altogether here now", "fr"), (5, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5]


def jaccard_cases():
    """Texts with edited copies from nearly equal to well below the rule, and the least row of each brute-force component."""
    rng = np.random.default_rng(5)
    texts = []
    for b in range(40):
        words = [f"t{b}x{rng.integers(0, 5000)}" for _ in range(rng.integers(30, 200))]
        texts.append(" ".join(words))
        for _ in range(6):
            copy = list(words)
            for at in rng.choice(len(copy), rng.integers(1, 2 + len(copy) // 40), replace=False):
                copy[at] = f"edit{rng.integers(0, 10**9)}"
            texts.append(" ".join(copy))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (n := len(sets[i] & sets[j])) and 5 * n >= 4 * len(sets[i] | sets[j])]
    least = list(range(len(texts)))
    while True:
        before = list(least)
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
        if least == before:
            return texts, pairs, least


def test_stage_reaches_jaccard_of_four_fifths(spark):
    texts, pairs, least = jaccard_cases()
    assert len(pairs) > 200 and 60 < len(set(least)) < len(texts) - 60
    assert sum((fingerprint(texts[i], 5) ^ fingerprint(texts[j], 5)).bit_count() > 3 for i, j in pairs) > len(pairs) / 2  # the 3-bit rule misses most
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for unit in (512, 3):  # whole keys, and keys cut into chunks
        assert sorted(r.doc_id for r in keep_one(df, unit=unit).collect()) == sorted(set(least))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_stage_fingerprints_are_simhashes(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50, n)) for n in (1, 4, 5, 6, 30, 300, 6000)] + ["A b\tC d e a B c D e", None, "", " \n "]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    got = {r[0]: r[1] for r in df.select("row", sample_prints_udf()("text")).collect()}
    mix, turn = np.random.default_rng(11).integers(0, 1 << 64, (2, SAMPLES * DRAWS), dtype=np.uint64).tolist()
    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        own = {xxhash.xxh64_intdigest(b" ".join(words[at : at + 5]), 42) for at in range(max(1, len(words) - 4))} if words else set()
        draws = [min((h ^ m) * (t | 1) % (1 << 64) for h in own) for m, t in zip(mix, turn, strict=True)] if own else []
        groups = [draws[at : at + DRAWS] for at in range(0, len(draws), DRAWS)] or [[]]
        want = {signed(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in group) > len(group))) for group in groups}
        assert got[i] == sorted(want)
