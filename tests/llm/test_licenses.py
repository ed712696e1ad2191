import re

from pyspark.sql import functions as F

from shutterlake.llm.licenses import BASE, NEED, RARE, TEMPLATES, scanned, words_of


def brute(texts):
    """Every start of every licence tried one by one."""
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or "")) for t in texts]
    used = {w for _, t, _ in TEMPLATES for w in t.split()}
    df = {}
    for own in words:
        for w in set(own) & used:
            df[w] = df.get(w, 0) + 1
    out = []
    for own in words:
        base = [(i, label) for p, label in BASE.items() for i in range(len(own)) if own[i : i + len(p.split())] == p.split()]
        labels, most = {x for _, x in base}, 0
        for label, text, key in TEMPLATES:
            text, key = text.split(), key.split()
            if not set(key) <= set(own):
                continue
            rare = set(sorted(set(own) & set(text), key=lambda w: (df[w], w))[:RARE])
            lead = next(i for i in range(len(text)) if text[i : i + len(key)] == key)
            for start in range(-len(text), len(own)):
                agree = sum(own[start + t] == w for t, w in enumerate(text) if w in rare and 0 <= start + t < len(own))
                most = max(most, agree)
                if agree >= NEED and start + lead >= 0 and own[start + lead : start + lead + len(key)] == key:
                    labels.add(label)
        at = [i for i, _ in base]
        join = lambda x: ",".join(sorted(set(x)))
        out.append((len(own), len(base), min(at, default=None), max(at, default=None), join(x for _, x in base), join(labels), 1.0 if base else min(1.0, most / RARE)))
    return out


def test_every_licence_has_its_key_phrase_and_is_found(spark):
    assert all(f" {key} " in f" {text} " and all(w in text.split() for w in key.split()) for _, text, key in TEMPLATES)
    df = spark.createDataFrame([(i, f"Some prose comes before. {t}") for i, (_, t, _) in enumerate(TEMPLATES)], "doc_id long, text string")
    assert all(TEMPLATES[r.doc_id][0] in r.labels.split(",") for r in scanned(df).collect())


def test_matches_brute_force(spark):
    texts = [t for _, t, _ in TEMPLATES] + [f"prose before. {t.upper()}, and after; {t}" for _, t, _ in TEMPLATES] + [
        None, "", "...", "Under the MIT-License under the mit license", "under the mit\nlicense under the mit license under the", "CC BY-NC CC-BY NC cc by nc", "Apache License, Version 2.0 and version 2",
        "permission is hereby granted free of charge", "gnu general public", "License", "under the m\u0130t license wor\u212a", "licensed under the gnu general public version 3 license",
        "mit " * 300 + "license under the mit license " * 50, "sharealike attribution commons creative", "dès l'été sous licence",
    ]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, labels string, _words int").repartition(3)
    out = scanned(df)
    assert "_words" in out.columns
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in out.collect()}
    for i, want in enumerate(brute(texts)):
        assert got[i] == want, texts[i]


def test_a_long_text_and_no_licence_word(spark):
    df = spark.createDataFrame([(1, "mit " * 3000 + "license under the mit license " * 500)], "doc_id long, text string")
    row = scanned(df).first()
    assert (row.n_base, row.labels.split(",")[0], row.score) == (500, "mit", 1.0)
    row = scanned(spark.createDataFrame([(1, "nothing here")], "doc_id long, text string")).first()
    assert (row.n_words, row.labels, row.score, row.spans) == (2, "", 0.0, [])


def test_clashing_names_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "cc by nc", "old"), (1, "cc by nc", "old"), (None, None, None)], "doc_id long, text string, labels string")
    assert sorted(r.labels for r in scanned(df).collect()) == ["", "cc-by-nc", "cc-by-nc"]
    assert scanned(df.limit(0)).count() == 0


def test_characters_that_lower_case_would_turn_into_ascii(spark):
    row = spark.createDataFrame([("WOR" + chr(0x212A) + " M" + chr(0x130) + "T Work ÉTÉ",)], "text string").select(words_of(F.col("text")).alias("w")).first()
    assert row.w == ["wor" + chr(0x212A), "m" + chr(0x130) + "t", "work", "ÉtÉ"]


def test_every_licence_of_a_file_is_found(spark):
    """Texts made of two licences with different labels lose neither."""
    pairs = [(a, b) for a in TEMPLATES for b in TEMPLATES if a[0] != b[0]]
    df = spark.createDataFrame([(i, f"{a[1]} and elsewhere {b[1]}") for i, (a, b) in enumerate(pairs)], "doc_id long, text string").repartition(4)
    lost = [r.doc_id for r in scanned(df).collect() if not {x[0] for x in pairs[r.doc_id]} <= set(r.labels.split(","))]
    assert not lost
