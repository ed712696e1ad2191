"""Columns of a caller that have names used inside, and rows of any kind, pass through every operator and stage that returns its input's rows."""

import corpus_pipeline
import pytest

from shutterlake.llm import exact_dedup, language_id, licenses, mixing, quality, simhash
from shutterlake.llm.names import free_name

NAMES = ["_row", "_ROW_", "_times", "_copy", "_words", "_hits", "_share", "_base0", "_said0", "_lang", "_rating", "row", "key", "component", "chosen", "word", "at", "a.b", "c`d"]
TEXT = "released under the mit license and some more words of a sentence that goes on for a while here"


@pytest.fixture
def docs(spark):
    rows = [(1, TEXT, "en", "s"), (2, "une phrase de quelques mots qui parle encore", "fr", "s"), (3, TEXT + " again", "en", None), (None, None, None, None), (5, "5", None, "s"), (6, "", "en", "s")]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES)
    return spark.createDataFrame([(*r, *[f"{n}{r[0]}" for n in NAMES]) for r in rows], schema)


def own(df):
    at = {n: i for i, n in enumerate(df.columns)}
    return [(r[0], [r[at[n]] for n in NAMES]) for r in df.collect()]


@pytest.mark.parametrize("operator", [exact_dedup.keep_one, simhash.keep_one, mixing.mix, language_id.keep_identified, language_id.identified, licenses.scanned, lambda d: quality.rated(d, None)])
def test_a_callers_columns_are_kept(docs, operator):
    out = operator(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    found = own(out)
    assert found and all(values == [f"{n}{i}" for n in NAMES] for i, values in found)


def test_stages_keep_clashing_columns(spark, docs, tmp_path):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_free_names(docs):
    assert free_name(docs, "_row") == "_row__" and free_name(docs, "other") == "other"
