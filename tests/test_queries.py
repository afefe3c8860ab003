"""Every registered query of the engine against its SQL; the others against plain Python."""

import math

import numpy as np
import pytest

from palimpsest import queries
from palimpsest.functions.scalar import fnv1a


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(spark, sf, duck, agree, name):
    agree(queries.QUERIES[name](spark, sf), duck, queries.ORACLES[name])


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["rowid", "score"]


def test_text_hashes(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for row in queries.text_hashes(spark, sf).collect():
        assert row.text_hash % 2**64 == fnv1a(texts[row.doc_id].encode())


def _candidates(spark, sf):
    rows = queries.scoring.composite(queries._scored(spark, sf), queries._SCORING, queries.NOW).select("rowid", "score", "vector").collect()
    return sorted(rows, key=lambda r: (-r.score, r.rowid))


def _cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def test_near_dedup_results(spark, sf):
    kept = []
    for row in _candidates(spark, sf):
        if all(_cosine(row.vector, k.vector) < 0.3 for k in kept):
            kept.append(row)
    got = queries.near_dedup_results(spark, sf).orderBy("rank").collect()
    assert [r.rowid for r in got] == [r.rowid for r in kept]


def test_mmr_top10(spark, sf):
    left, chosen = _candidates(spark, sf), []
    while left and len(chosen) < 10:
        best = max(left, key=lambda r: 0.5 * r.score - 0.5 * max((_cosine(r.vector, c.vector) for c in chosen), default=0.0))
        chosen.append(best)
        left.remove(best)
    got = queries.mmr_top10(spark, sf).orderBy("rank").collect()
    assert [r.rowid for r in got] == [r.rowid for r in chosen]


def test_measured_recall(spark, sf):
    """Over every query of the stated set the cells and the byte codes find at least 0.95 of the true neighbours."""
    rows = queries.recall_report(spark, sf).collect()
    assert len(rows) == 25 and all(r.n == 10 for r in rows)
    assert np.mean([r.cells_recall for r in rows]) >= 0.95 and np.mean([r.codes_recall for r in rows]) >= 0.95
