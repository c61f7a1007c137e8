"""Columns of the user whose names the operators use inside come through every filter unchanged."""

import pytest
from pyspark.sql import functions as F

from orderpath.llm import heavy_dedup, lexicon, setsketch, winnowing

NAMES = ["_id", "_digest", "_digest_here", "_n", "_hash", "_row", "row", "digest", "text_hash", "document", "number", "id", "hash",
         "kept", "keep_id", "doc_id_there", "digest_there", "id_there", "words", "n_words", "best", "node", "comp", "a.b", "Document_"]
LONG = " ".join(f"word{i}" for i in range(40))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "same text here"), (2, "same  text here"), (3, LONG), (4, LONG + " more"), (5, None), (None, ""), (6, "benchmark " + LONG), (7, "alone"), (7, "alone")]
    named = spark.createDataFrame(rows, "doc_id long, text string")
    return named.select("*", *[F.lit(f"v{i}").alias(name) for i, name in enumerate(NAMES)])


def outcome(left, docs):
    assert left.columns == docs.columns and left.dtypes == docs.dtypes
    rows = left.collect()
    assert all(list(r)[2:] == [f"v{i}" for i in range(len(NAMES))] for r in rows)
    return sorted([(r["doc_id"], r["text"]) for r in rows], key=str)


def test_exact_copies(docs):
    kept = outcome(heavy_dedup.drop_copies(docs), docs)
    assert kept == sorted([(2, "same  text here"), (3, LONG), (4, LONG + " more"), (6, "benchmark " + LONG), (7, "alone"), (None, "")], key=str)
    without = docs.where("doc_id < 7")
    assert len(outcome(heavy_dedup.drop_copies(without), without)) == 5


def test_near_copies(docs):
    kept = outcome(setsketch.drop_near_duplicates(docs), docs)
    assert (3, LONG) in kept and (4, LONG + " more") not in kept and (1, "same text here") in kept and (2, "same  text here") not in kept
    assert (5, None) in kept and (None, "") in kept


def test_contaminated(spark, docs):
    bench = spark.createDataFrame([("i", LONG), (None, None)], "item_id string, text string")
    kept = outcome(winnowing.drop_contaminated(docs, bench), docs)
    assert kept == sorted([(1, "same text here"), (2, "same  text here"), (5, None), (None, ""), (7, "alone"), (7, "alone")], key=str)


def test_toxic_counts_null_as_empty(spark, docs):
    labels = spark.createDataFrame([(1, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    learned = lexicon.learn_lexicon(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in lexicon.score_documents(docs, learned).collect()}
    assert scores[5] == scores[None]
    for threshold in (0.7, 0.0):
        kept = outcome(lexicon.drop_toxic(docs, learned, threshold), docs)
        assert ((5, None) in kept) == ((None, "") in kept) == (scores[5] < threshold)
