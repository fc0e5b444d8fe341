"""Correlations from merged co-moment matrices against plain ones."""

from __future__ import annotations

import math
import time
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dataproof import column_statistics, correlations
from dataproof.operators import comoments, profile
from dataproof.plans.compiled import small_methods


def plain(a, b):
    """Pearson over the rows that have both values; None where it is undefined."""
    pairs = [(x, y) for x, y in zip(a, b) if x is not None and y is not None]
    if not pairs or not all(math.isfinite(x) and math.isfinite(y) for x, y in pairs):
        return None
    x, y = (np.array(side, dtype=np.longdouble) for side in zip(*pairs))
    if x.min() == x.max() or y.min() == y.max():
        return None
    x, y = x - x.mean(), y - y.mean()
    return float((x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum()))


def check(found, columns):
    names = list(columns)
    assert [(a, b) for _, a, b, _ in found] == list(combinations(names, 2))
    for _, a, b, r in found:
        expected = plain(columns[a], columns[b])
        assert r == (None if expected is None else pytest.approx(expected, abs=1e-8)), (a, b)


def test_odd_columns(spark):
    rng = np.random.default_rng(3)
    n = 500
    base = rng.normal(size=n)
    columns = {
        "base": base.tolist(),
        "far": (1e12 + 1000 * base + rng.normal(size=n)).tolist(),
        "holes": [None if i % 3 == 0 else float(x) for i, x in enumerate(rng.normal(size=n) + base)],
        "constant": [0.1] * n,
        "constant where holes": [float(i) if i % 3 == 0 else 7.3 for i in range(n)],
        "empty": [None] * n,
        "nan": [float("nan") if i == 9 else float(i) for i in range(n)],
        "inf in a hole": [float("inf") if i == 9 else float(i % 17) for i in range(n)],
        "one": [None] * (n - 1) + [1.0],
        "huge": (1e200 * rng.normal(size=n)).tolist(),
        "tiny": (1e-200 * base).tolist(),
    }
    schema = ", ".join(f"`{name}` double" for name in columns)
    for parts in (1, 7):
        df = spark.createDataFrame(list(zip(*columns.values())), schema).repartition(parts)
        statistics = column_statistics(df, distinct=False, moments=False)
        columns_in_range = {name: values for name, values in columns.items() if name not in ("huge", "tiny")}
        found = [row for row in correlations(df, statistics) if not {row[1], row[2]} & {"huge", "tiny"}]
        check(found, columns_in_range)


def test_types_and_no_rows(spark):
    df = spark.sql("SELECT id AS `a.b`, CAST(id * id AS DECIMAL(20, 3)) AS d, CAST(id AS FLOAT) / 3 AS f, 'x' AS t FROM range(50)")
    found = correlations(df, column_statistics(df, distinct=False, moments=False))
    check(found, {"a.b": [float(r["a.b"]) for r in df.collect()], "d": [float(r.d) for r in df.collect()], "f": [r.f for r in df.collect()]})
    empty = df.where("false")
    assert [r for *_, r in correlations(empty, column_statistics(empty, distinct=False, moments=False))] == [None] * 3
    assert correlations(df.select("t", "d"), column_statistics(df.select("t", "d"), distinct=False, moments=False)) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.one_of(st.none(), st.integers(-1000, 1000))] * 3), min_size=1, max_size=40), st.integers(1, 6))
def test_merging_in_any_cut(rows, step):
    """Batches of any size, merged in any order, give the co-moments of all rows at once."""
    values = np.array([[math.nan if x is None else x for x in row] for row in rows], dtype=float)
    present = np.array([[x is not None for x in row] for row in rows])
    whole = comoments.correlations_of(comoments.batch_matrices(values, present))
    parts = [comoments.batch_matrices(values[i : i + step], present[i : i + step]) for i in range(0, len(rows), step)]
    for order in (parts, parts[::-1]):
        merged = comoments.correlations_of(comoments._merge_all(order))
        assert np.allclose(merged, whole, atol=1e-9, equal_nan=True)
    columns = list(zip(*rows))
    for a, b in combinations(range(3), 2):
        expected = plain(columns[a], columns[b])
        assert math.isnan(whole[a, b]) if expected is None else whole[a, b] == pytest.approx(expected, abs=1e-9)


def test_a_hundred_columns(spark):
    """The plan does not grow with the pairs, and twice the columns do not cost many times as much."""
    seconds = {}
    for width in (50, 100):
        columns = ", ".join(f"CAST((id * {i + 3} + id % 7 * {i}) % {101 + i} AS DOUBLE) AS c{i}" for i in range(width))
        df = spark.sql(f"SELECT {columns} FROM range(20000)")
        statistics = column_statistics(df, distinct=False, moments=False)
        started = time.perf_counter()
        found = correlations(df, statistics)
        seconds[width] = time.perf_counter() - started
        assert len(found) == width * (width - 1) // 2 and all(r is not None for *_, r in found)
    matrix = np.array([[(i * (j + 3) + i % 7 * j) % (101 + j) for j in range(100)] for i in range(20000)], dtype=float)
    expected = np.corrcoef(matrix.T)
    assert [r for *_, r in found] == pytest.approx([expected[a, b] for a, b in combinations(range(100), 2)], abs=1e-9)
    assert seconds[100] < 8 * seconds[50] + 5


def test_counts_of_many_columns_do_not_expand_rows(spark):
    df = spark.range(10).selectExpr(*[f"CASE WHEN id % {i + 2} = 0 THEN NULL ELSE id END AS c{i}" for i in range(48)])
    counted = profile._scalar_frame(df, df.schema.fields, False)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "keys=[position" not in plan
    expected = {i: sum(x % (i + 2) != 0 for x in range(10)) for i in range(48)}
    assert {row["position"]: row["present"] for row in counted.collect()} == expected


def test_limit_of_methods_is_put_back(spark):
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    with pytest.raises(ZeroDivisionError), small_methods(spark):
        assert int(spark.conf.get(limit)) <= 8000
        raise ZeroDivisionError
    assert spark.conf.get(limit) == before


def test_batches_with_and_without_gaps():
    rng = np.random.default_rng(5)
    values = rng.normal(size=(200, 5)) + [0, 1e6, -3, 5, 0]
    present = np.ones(values.shape, dtype=bool)
    present[::3, 1] = present[::7, 4] = False
    values[~present] = np.nan
    values[5, 3] = np.inf
    found = comoments.batch_matrices(values, present)
    for a in range(5):
        for b in range(5):
            both = present[:, a] & present[:, b]
            sound = both & np.isfinite(values[:, a]) & np.isfinite(values[:, b])
            x, y = values[sound, a], values[sound, b]
            assert found["rows"][a, b] == sound.sum() and found["odd"][a, b] == (both & ~sound).sum()
            assert np.isclose(found["mean_a"][a, b], x.mean()) and np.isclose(found["mean_b"][a, b], y.mean())
            assert np.isclose(found["square_a"][a, b], ((x - x.mean()) ** 2).sum())
            assert np.isclose(found["product"][a, b], ((x - x.mean()) * (y - y.mean())).sum())
