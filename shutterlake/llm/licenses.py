"""Licence scans by a positional index of rare words. DataFrame functions only.

Method. Every word of every licence text is indexed with the positions at which it stands. A scanned text tries each licence whose key phrase's words it all
holds, so each of several licences in one file is tried: it looks up its ``RARE`` words of the highest inverse document frequency among that licence's words, and an
occurrence at position p of a word that stands at position t of the licence speaks for the licence starting at p - t. Postings are
intersected by these relative positions: a start that ``NEED`` occurrences agree on is a candidate, and the label is given if the licence's
mandatory key phrase stands there word for word. Base phrases are found wherever their words stand consecutively.

Document frequencies are counted over all texts, for the few hundred words of the licences; they are all that reaches the driver. Words are taken
from whole texts, and everything after the counts happens within a row, in one pass over its words.

``score``: 1 with a base label, else the share of ``RARE`` that the best start of a licence that was tried has in occurrences, 1 at most.

Defined cases: a null text counts as empty; one without words has no labels, null word positions and score 0. Upper and lower case A-Z are
the same, other characters are themselves. Equal frequencies are ordered by word. Repeated rows give equal rows, an empty table an empty result. A
column that has the name of a result gives way to it; all others pass through.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.license_texts import LICENSE_TEXTS
from shutterlake.llm.names import free_name
from shutterlake.sources.tables import read_table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE, NEED = 8, 3
#: Phrases that are labels by themselves.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: The word of each base phrase whose places are looked at, and its place in the phrase.
ANCHORS = {"under the mit license": ("mit", 2), "apache license version 2": ("apache", 0), "cc by nc": ("nc", 2)}
#: Label, words and key phrase of each licence.
TEMPLATES = tuple((label, " ".join(re.findall(WORD, text.lower())), key) for label, key, text in LICENSE_TEXTS)


def words_of(text: Column) -> Column:
    """Words with A-Z in lower case. ``lower`` does that but for the two characters that it turns into ASCII letters."""
    plain = F.when(text.rlike(r"[\u0130\u212A]"), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))
    return F.regexp_extract_all(F.coalesce(plain, F.lit("")), F.lit(WORD), F.lit(0))


def index_words(templates=TEMPLATES) -> list[str]:
    """The words of all licences, in order."""
    return sorted({w for _, text, _ in templates for w in text.split()})


def document_frequencies(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> dict[str, int]:
    """In how many texts each word of the licences occurs; words in none are left out."""
    words = F.array(*[F.lit(w) for w in index_words(templates)])
    found = F.array_intersect(words, words_of(F.col(text_col)))
    return {r.word: r["count"] for r in docs.select(F.explode(found).alias("word")).groupBy("word").count().collect()}


def _licences(ranked: list[str], templates) -> Column:
    """Each licence as a row: label, place of its key phrase, the phrase's words, and its words in the order of ``ranked`` with their positions."""
    rows = []
    for label, text, key in templates:
        own = text.split()
        rare = sorted(set(own), key=lambda w: ranked.index(w) if w in ranked else len(ranked))
        index = F.array(*[F.struct(F.lit(w).alias("w"), F.array(*[F.lit(i) for i, x in enumerate(own) if x == w]).alias("at")) for w in rare])
        lead = (" " + text + " ").split(f" {key} ")[0].count(" ")
        rows.append(F.struct(F.lit(label).alias("label"), F.lit(lead).alias("lead"), F.array(*map(F.lit, key.split())).alias("key"), index.alias("index")))
    return F.array(*rows)


def _base_starts(words: Column, hits: Column, phrase: str) -> Column:
    """Where a base phrase stands."""
    own, (anchor, lead) = phrase.split(), ANCHORS[phrase]
    starts = F.transform(F.filter(hits, lambda h: h["w"] == anchor), lambda h: h["at"] - lead)
    stands = lambda d: reduce(lambda a, b: a & b, [F.get(words, d + k) == w for k, w in enumerate(own)])
    return F.filter(starts, lambda d: (d >= 0) & stands(d))


def _made(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are made once a row: they come out of a generator of one row, so that no later expression takes their definitions in and makes them anew for every element it looks at."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _most_agreeing(said: Column) -> Column:
    """The length of the longest run of equal entries in a sorted array."""

    def longer(a: Column, d: Column) -> Column:
        run = F.when(d == a["last"], a["run"] + 1).otherwise(1)
        return F.struct(d.alias("last"), run.alias("run"), F.greatest(a["most"], run).alias("most"))

    none = F.lit(None).cast("int")
    return F.aggregate(said, F.struct(none.alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most")), longer, lambda a: a["most"])


def scanned(docs: DataFrame, text_col: str = "text", templates=TEMPLATES, need: int = NEED, rare: int = RARE) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and ``spans``: (label, start) of each licence found by the index."""
    frequency = document_frequencies(docs, text_col, templates)
    ranked = sorted(frequency, key=lambda w: (frequency[w], w))  # the highest inverse document frequency first; words in no text can't be looked up
    names = {x: free_name(docs, f"_{x}") for x in ("words", "held", "tried", "wanted", "hits", "said", "starts")}
    words, held, tried, wanted, hits, said, starts = (F.col(x) for x in names.values())
    anchors = sorted({w for w, _ in ANCHORS.values()})

    out = _made(docs, **{names["words"]: words_of(F.col(text_col))})
    licence_words = F.array(*[F.lit(w) for w in ranked]) if ranked else F.array().cast("array<string>")
    out = _made(out, **{names["held"]: F.array_intersect(licence_words, words)})
    # of each licence whose key phrase's words are all there: its rarest words that are there
    open_ = F.filter(_licences(ranked, templates), lambda t: F.size(F.array_except(t["key"], held)) == 0)
    looked_up = lambda t: F.slice(F.filter(t["index"], lambda x: F.array_contains(held, x["w"])), 1, rare)
    out = _made(out, **{names["tried"]: F.transform(open_, lambda t: F.struct(t["label"].alias("label"), t["lead"].alias("lead"), t["key"].alias("key"), looked_up(t).alias("index")))})
    out = _made(out, **{names["wanted"]: F.array_distinct(F.flatten(F.transform(tried, lambda t: F.transform(t["index"], lambda x: x["w"]))))})
    out = _made(out, **{names["hits"]: F.filter(F.transform(words, lambda w, i: F.when(w.isin(anchors) | F.array_contains(wanted, w), F.struct(w.alias("w"), i.alias("at")))), lambda x: x.isNotNull())})

    # where each licence would start, sorted, by licence
    starts_of = lambda x: F.flatten(F.transform(F.filter(hits, lambda h: h["w"] == x["w"]), lambda h: F.transform(x["at"], lambda at: h["at"] - at)))
    spoken = lambda t: F.array_sort(F.flatten(F.transform(t["index"], starts_of)))
    out = _made(out, **{names["said"]: F.transform(tried, lambda t: F.struct(t["label"].alias("label"), t["lead"].alias("lead"), t["key"].alias("key"), spoken(t).alias("starts")))})
    agreed = lambda t: F.array_distinct(F.filter(t["starts"], lambda d, i: F.get(t["starts"], i + (need - 1)) == d))
    stands = lambda t, d: (d + t["lead"] >= 0) & (F.slice(words, F.greatest(d + t["lead"], F.lit(0)) + 1, F.size(t["key"])) == t["key"])
    spans = F.flatten(F.transform(said, lambda t: F.transform(F.filter(agreed(t), lambda d: stands(t, d)), lambda d: F.struct(t["label"].alias("label"), d.alias("start")))))
    most = F.coalesce(F.array_max(F.transform(said, lambda t: _most_agreeing(t["starts"]))), F.lit(0))

    out = _made(out, **{names["starts"]: F.array(*[F.struct(F.lit(label).alias("label"), _base_starts(words, hits, p).alias("at")) for p, label in BASE.items()])})
    every = F.flatten(starts["at"])
    base = F.transform(F.filter(starts, lambda b: F.size(b["at"]) > 0), lambda b: b["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    out = out.withColumn("spans", spans)
    out = out.withColumns({
        "n_words": F.size(words).cast("long"), "n_base": F.size(every).cast("long"), "first_word": F.array_min(every).cast("long"), "last_word": F.array_max(every).cast("long"),
        "base_labels": joined(base), "labels": joined(F.concat(base, F.transform("spans", lambda s: s["label"]))),
        "score": F.when(F.size(every) > 0, 1.0).otherwise(F.least(F.lit(1.0), most / float(rare))),
    })
    return out.drop(*names.values())


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scanned(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _rows(items) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in items)


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
b(phrase, label) AS (VALUES {_rows(BASE.items())}),
t(no, label, template, phrase) AS (VALUES {_rows((i, *x) for i, x in enumerate(TEMPLATES))}),
tw AS (SELECT no, unnest(string_split(template, ' ')) AS word, generate_subscripts(string_split(template, ' '), 1) - 1 AS pos FROM t),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM d),
lw AS (SELECT * FROM w WHERE word IN (SELECT word FROM tw)),
f AS (SELECT word, row_number() OVER (ORDER BY count(DISTINCT doc_id), word) AS idf FROM lw GROUP BY word),
h AS (SELECT DISTINCT doc_id, word, idf FROM lw JOIN f USING (word)),
kw AS (SELECT DISTINCT no, unnest(string_split(phrase, ' ')) AS word FROM t),
o AS (SELECT doc_id, no FROM h JOIN kw USING (word) GROUP BY doc_id, no HAVING count(*) = (SELECT count(*) FROM kw AS x WHERE x.no = kw.no)),
c AS (SELECT doc_id, no, word FROM o JOIN h USING (doc_id) JOIN (SELECT DISTINCT no, word FROM tw) USING (no, word) QUALIFY row_number() OVER (PARTITION BY doc_id, no ORDER BY idf) <= {RARE}),
a AS (SELECT doc_id, no, lw.pos - tw.pos AS start, count(*) AS agree FROM lw JOIN c USING (doc_id, word) JOIN tw USING (no, word) GROUP BY ALL),
share AS (SELECT doc_id, least(1.0::DOUBLE, max(agree) / {RARE}::DOUBLE) AS share FROM a GROUP BY doc_id),
k AS (SELECT *, len(string_split(phrase, ' ')) AS len, len(string_split(split_part(' ' || template || ' ', ' ' || phrase || ' ', 1), ' ')) - 1 AS lead FROM t),
v AS (
  SELECT a.doc_id, k.label FROM a JOIN k USING (no) JOIN d USING (doc_id)
  WHERE a.agree >= {NEED} AND a.start + k.lead >= 0 AND array_to_string(list_slice(d.words, a.start + k.lead + 1, a.start + k.lead + k.len), ' ') = k.phrase
),
p AS (
  SELECT w.doc_id, b.label, w.pos FROM w JOIN b ON w.word = split_part(b.phrase, ' ', 1) JOIN d USING (doc_id)
  WHERE array_to_string(list_slice(d.words, w.pos + 1, w.pos + len(string_split(b.phrase, ' '))), ' ') = b.phrase
),
pb AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM v UNION ALL SELECT doc_id, label FROM p) GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN pb USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN share USING (doc_id)
"""
