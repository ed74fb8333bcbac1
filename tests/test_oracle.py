"""Every registered query of the grid library with SQL gives what DuckDB gives; the others give rows."""

from __future__ import annotations

import pytest

from geogrid.plans.catalogue import QUERIES, SQL
from tests.conftest import DATA, rows_of

# Rows that a query without SQL gives on the smallest tables, and columns whose values are within a range.
ROWS = {
    "mdl1_boosted_trees": 10, "mdl4_ensemble": 500, "mdl5_ensemble_inference": 300, "mdl7_probes": 34, "mdl8_best_clustering": 18, "mdl9_cluster_sweep": 29,
    "srt5_best_start": 20, "snk5_stored_model": 300,
}
RANGES = {"accuracy": (0, 1), "mean": (-1, 1), "low": (0, 1), "high": (0, 1), "pr_auc": (0, 1), "roc_auc": (0, 1), "f1": (0, 1), "mcc": (-1, 1), "r2": (-9, 1), "n": (1, 10**9), "sse": (0, 1e9), "silhouette_mean": (-1, 1)}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    cols, found = rows_of(QUERIES[name](spark, DATA).toPandas())
    ref_cols, ref = rows_of(duck.sql(SQL[name]).df())
    assert cols == ref_cols
    assert len(found) == len(ref)
    # A last digit may be rounded either way.
    for a, b in zip(found, ref, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or abs(float(x) - float(y)) <= 2e-4, (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    rows = QUERIES[name](spark, DATA).collect()
    assert len(rows) == ROWS.get(name, len(rows)) and rows
    for r in rows:
        for c, (low, high) in RANGES.items():
            assert c not in r or r[c] is None or low - 1e-9 <= r[c] <= high + 1e-9, r
    assert all(any(r[c] is not None for r in rows) for c in rows[0].asDict())


def test_models_are_better_than_chance(spark):
    found = {(r["features"], r["part"]): r for r in QUERIES["mdl1_boosted_trees"](spark, DATA).collect()}
    assert found["all", "test"]["roc_auc"] > 0.9 > found["A", "test"]["roc_auc"]
    kept = [r for r in QUERIES["srt5_best_start"](spark, DATA).collect()]
    assert [r["sse"] for r in kept if r["kept"]] == [min(r["sse"] for r in kept)]
