import math
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import rows
from nebulith.operators.copy_diff import compare_copies

SCHEMA = "id long, mass double, vx double, name string, ingested_at int"


def brute(a, b, tol=1e-9):
    def same(u, v):
        if u is None or v is None:
            return u is None and v is None
        if isinstance(u, str):
            return u == v
        if math.isnan(u) or math.isnan(v):
            return math.isnan(u) and math.isnan(v)
        return u == v or abs(u - v) <= tol * max(abs(u), abs(v))

    x, y = {r[0]: r for r in a}, {r[0]: r for r in b}
    out = [(k, "missing_in_left") for k in y.keys() - x.keys()] + [(k, "missing_in_right") for k in x.keys() - y.keys()]
    for k in x.keys() & y.keys():
        out += [(k, c) for i, c in ((1, "mass"), (2, "vx"), (3, "name")) if not same(x[k][i], y[k][i])]
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(3)
    values = [None, float("nan"), 0.0, -0.0, 1.0, 1.0 + 1e-12, 1.0 + 1e-8, float("inf")]
    a = [(i * 7 - 300, rng.choice(values), rng.choice(values), rng.choice([None, "a", "b"]), 1) for i in range(300)]
    b = [(k, rng.choice([m, m, rng.choice(values)]), v, n, 2) for k, m, v, n, _ in a if rng.random() < 0.95] + [(10_000_019, 1.0, 1.0, "x", 2)]
    left, right = spark.createDataFrame(a + a[:40], SCHEMA), spark.createDataFrame(b + b[:5], SCHEMA)
    assert rows(compare_copies(left, right, "id", ("ingested_at",))) == brute(a, b)


def test_empty_sides_and_null_keys(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(5, 1.0, None, "a", 1), (None, 2.0, 2.0, "b", 1)], SCHEMA)
    assert rows(compare_copies(none, none, "id", ("ingested_at",))) == []
    assert rows(compare_copies(one, none, "id", ("ingested_at",))) == [(5, "missing_in_right")]
    assert rows(compare_copies(none, one, "id", ("ingested_at",))) == [(5, "missing_in_left")]


def test_equal_copies_stop_at_the_root(spark):
    df = spark.range(1000).selectExpr("id", "cast(id as double) as mass", "null as vx", "'n' as name", "1 as ingested_at").selectExpr("id", "mass", "cast(vx as double) vx", "name", "ingested_at")
    assert rows(compare_copies(df, df, "id", ("ingested_at",))) == []


def test_clashing_and_one_sided_columns(spark):
    a = spark.createDataFrame([(1, 2, "x", 3.0)], "id long, _side int, _leaf string, only_left double")
    b = spark.createDataFrame([(1, 4, "x", 3.0)], "id long, _side int, _LEAF string, only_right double")
    assert rows(compare_copies(a, b, "id")) == [(1, "_side")]


def test_hot_key_with_contradicting_copies(spark):
    a = spark.createDataFrame([(7, float(i % 3), 0.0, "n", 0) for i in range(3000)] + [(i, 1.0, 1.0, "n", 0) for i in range(100, 200)], SCHEMA)
    b = spark.createDataFrame([(7, 2.0, 0.0, "n", 0)] + [(i, 1.0, 1.0, "n", 0) for i in range(100, 200)], SCHEMA)
    assert rows(compare_copies(a, b, "id", ("ingested_at",))) == []  # the largest copy is compared


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(-50, 50), st.sampled_from([1.0, 2.0, None]), max_size=12), st.dictionaries(st.integers(-50, 50), st.sampled_from([1.0, 2.0, None]), max_size=12))
def test_any_tables(spark, x, y):
    a, b = [(k, v, 0.0, None, 0) for k, v in x.items()], [(k, v, 0.0, None, 0) for k, v in y.items()]
    got = rows(compare_copies(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "id", ("ingested_at",)))
    assert got == brute(a, b)


def test_columns_of_one_side_are_named(spark):
    from nebulith.operators.copy_diff import column_sides

    a, b = spark.createDataFrame([], "id long, Mass double, rank int"), spark.createDataFrame([], "id long, mass double, note string")
    assert sorted(tuple(r) for r in column_sides(a, b, "a", "b").collect()) == [("Mass", "both"), ("id", "both"), ("note", "b"), ("rank", "a")]
