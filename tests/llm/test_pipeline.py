"""The pipeline against plain Python over the same rules, on a small folder of tables."""

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from shutterlake.llm.bpe import unpacked, vocabulary_path
from shutterlake.llm.queries import ORACLES, QUERIES


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_run_matches_plain_python(spark, tmp_path):
    rng = np.random.default_rng(2)
    vocabulary = {"en": "the of and to in that is was for with".split(), "fr": "le la les des une est dans pour avec mais".split()}
    rows = []
    for i in range(150):
        lang = ("en", "fr")[i % 2]
        rows.append((i, " ".join(f"{rng.choice(vocabulary[lang])}{rng.integers(0, 30)}" for _ in range(rng.integers(8, 80))), lang, f"s{i % 4}", 1))
    rows += [(200 + i, rows[i][1], "en", "s0", 1) for i in range(10)]
    rows += [(300, None, "en", "s1", 0), (301, "12 34", "en", "s1", 5), (302, "", None, None, 0), (303, rows[3][1] + " x", "fr", None, 1)]
    for i in range(20):  # one word of a text is another: near copies by Jaccard if the text is long, though over 3 bits apart
        words = rows[i][1].split()
        words[int(rng.integers(len(words)))] = "other"
        rows.append((400 + i, " ".join(words), "en", "s2", 1))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).withColumn("tokens", unpacked(F.col("ids"))).collect()

    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    last = {}
    for r in kept:
        last[r[1]] = max(r, last.get(r[1], r), key=lambda x: x[0])
    kept, groups = sorted(last.values()), []
    for r in kept:  # chains of links make one group
        p = shingles(r[1])
        near = [g for g in groups if any(5 * len(p & q) >= 4 * len(p | q) for q, _ in g)]
        groups = [g for g in groups if g not in near] + [[(p, r), *[x for g in near for x in g]]]
    assert sum(len(g) > 1 for g in groups) > 5
    firsts = {min(r[0] for _, r in g) for g in groups}
    texts = {r[0]: r[1] for r in kept if r[0] in firsts}
    tok = Tokenizer.from_file(vocabulary_path())
    assert {r.doc_id for r in out} <= set(texts)
    assert len(out) >= len(firsts)  # half as many words again are taken as there are
    assert all(r.round_trip and r.tokens == tok.encode(texts[r.doc_id]).ids and r.n_tokens == len(r.tokens) for r in out)
    total = sum(len(t.split()) for t in texts.values())
    assert abs(sum(len(texts[r.doc_id].split()) for r in out) - 1.5 * total) < 0.1 * total


def test_stages_keep_the_columns_and_survive_empty_input(spark, tmp_path):
    docs = spark.createDataFrame([(None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, str(tmp_path)).columns == docs.columns


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
