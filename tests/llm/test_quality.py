import zlib

import numpy as np
import pytest

from ferrule.llm.quality import accepted, features, fit, quality_scores
from ferrule.llm.sources import table


@pytest.fixture(scope="module")
def scored(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return {r.doc_id: r for r in quality_scores(docs, labels).collect()}, {r.doc_id: r.quality for r in labels.collect()}, docs, labels


def test_held_out_accuracy(scored):
    rows, quality, _, _ = scored
    assert len(rows) == 1000
    held = [r for r in rows.values() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows.values())
    seen = [(r.score, quality[r.doc_id]) for r in held if r.doc_id in quality]
    good, bad = [s for s, q in seen if q], [s for s, q in seen if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean([(s >= 0.3) == bool(q) for s, q in seen]) > 0.95
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows.values())


def test_held_out_labels_are_not_seen(scored, spark):
    """Turning every held-out label around changes no score."""
    from pyspark.sql import functions as F

    from ferrule.llm.quality import held_out

    rows, _, docs, labels = scored
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality_scores(docs, turned).collect()}
    assert all(again[k] == r.score for k, r in rows.items())


def test_filter_keeps_rows_whole(scored, spark):
    rows, _, docs, labels = scored
    kept = accepted(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {k for k, r in rows.items() if r.predicted}


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 7), (None, "x", 7), (2, "", 7), (2, "", 7), (3, "ab " * 200_000, 7)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_scores(docs, none).collect()
    assert len(rows) == 5 and all(r.score == pytest.approx(0.5) for r in rows)
    assert quality_scores(docs.limit(0), none).count() == 0
    odd = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert quality_scores(docs, odd).count() == 5


def test_long_texts_are_read_in_pieces_without_a_seam():
    import ferrule.llm.quality as q

    text = "Some words, then others 12.\n" * 400
    whole = set(features(text).tolist())
    q.PIECE, old = 1 << 10, q.PIECE
    try:
        cut = set(features(text).tolist())
    finally:
        q.PIECE = old
    assert whole <= cut and len(cut) < len(whole) + 200  # word shapes may see a cut word


def test_fit_separates():
    rows = [np.array([1, 2, 3], np.int32), np.array([1, 2, 9], np.int32), np.array([4, 5, 3], np.int32), np.array([4, 5, 9], np.int32)] * 20
    good = np.array([True, True, False, False] * 20)
    m = fit(rows, good)
    assert all((m.score(x) > 0.5) == g for x, g in zip(rows, good))
