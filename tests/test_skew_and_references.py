import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import rows
from nebulith.operators import references as R
from nebulith.operators import skew


def skewed(spark, n=4000):
    rng = random.Random(2)
    data = [(rng.choice([1, 1, 1, None, 2, rng.randrange(50)]), i, rng.randrange(5)) for i in range(n)]
    return data, spark.createDataFrame(data, "key long, pos long, v long").repartition(5)


def test_stitched_rank_sum_and_lag(spark):
    data, df = skewed(spark)
    got = skew.stitched(df, ["key"], ["pos"], sums={"run": F.col("v")}, lags={"before": "v"}, partitions=9).collect()
    groups = defaultdict(list)
    for k, p, v in data:
        groups[k].append((p, v))
    want = {}
    for k, items in groups.items():
        total, prev = 0, None
        for i, (p, v) in enumerate(sorted(items), 1):
            total += v
            want[p] = (k, v, i, total, prev)
            prev = v
    assert {r["pos"]: (r["key"], r["v"], r["_rn"], r["run"], r["before"]) for r in got} == want


def test_heavy_key_is_split(spark):
    df = spark.range(20_000).selectExpr("cast(0 as long) as key", "id as pos")
    sizes = skew.range_split(df, ["key"], ["pos"], 8).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 2 * 20_000 / 8


def test_hot_keys_count_null_rows_but_never_name_them(spark):
    df = spark.createDataFrame([(None, 1)] * 60 + [(5, 1)] * 30 + [(6, 1)] * 9 + [(7, 1)], "n long, total long")
    got = skew.hot_keys(df, "n", ["total"], 0.1)
    assert rows(got) == [(5, 30, 100)]
    assert rows(skew.hot_keys(df.limit(0), "n", ["total"], 0.1)) == []


def test_stitched_empty(spark):
    assert skew.stitched(spark.createDataFrame([], "key long, pos long"), ["key"], ["pos"]).count() == 0


def test_salted_join_equals_plain_join(spark):
    left = spark.range(30_000).selectExpr("id as ref", "cast(case when id % 3 = 0 then 1 else id % 97 end as string) as target")
    right = spark.range(50).selectExpr("cast(id as string) as target", "id * 2 as twice")
    assert skew.heavy_values(left, "target", 4)
    a = skew.salted_left_join(left, right, "target", "ref", 4).select("ref", "twice")
    b = left.join(right, "target", "left").select("ref", "twice")
    assert rows(a.na.fill(-1)) == rows(b.na.fill(-1))


@pytest.mark.parametrize("keys", [["target"], ["step", "target"]])
def test_pieces_follow_the_share_and_bound_the_largest_task(spark, keys):
    """Half of all rows bear one key: no task of the join may get more than a small part of them."""
    n = 40_000
    left = spark.range(n).selectExpr("id as ref", "cast(1 as long) as step", "case when id % 2 = 0 then 7 else id end as target")
    right = spark.range(n).selectExpr("cast(1 as long) as step", "id as target", "id * 2 as twice")
    heavy = skew.heavy_values(left, keys, 32)
    assert [r[-2:] for r in heavy] == [(7, 17)]  # 20,001 of 40,000 rows in shares of 1,250
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew.salted_join(left, right, keys, ["ref"], heavy)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == n and max(sizes) < n / 6


def test_small_tables_are_salted_too(spark):
    left = spark.createDataFrame([(i, 1) for i in range(8)] + [(9, None), (10, 2)], "ref long, target long")
    assert skew.heavy_values(left, "target", 4) == [(1, 4)]
    right = spark.createDataFrame([(1, "x"), (None, "y")], "target long, v string")
    got = {r["ref"]: r["v"] for r in skew.salted_left_join(left, right, "target", "ref", 4).collect()}
    assert got == {**{i: "x" for i in range(8)}, 9: None, 10: None}
    assert skew.salted_left_join(left.limit(0), right, "target", "ref").count() == 0


TRACERS = "particle_id long, snap_step long, parent long, ingested_at int, target string, state string"


def states(spark, refs, parents):
    r = R.references(spark.createDataFrame(refs, TRACERS), "t", "parent", "p", "particle_id")
    p = R.parent_intervals(spark.createDataFrame(parents, "key long, removed_step long, ingested_at int"), "p", "key")
    return R.reference_states([r], [p])


def test_reference_states(spark):
    refs = [(1, 10, 100, 5, "x", "y"), (2, 10, 101, 5, None, None), (3, 10, 102, 5, "", ""), (4, 10, 103, 5, "", ""), (5, 10, None, 5, "", ""), (6, 10, 0, 5, "", ""), (7, 10, 4294967295, 5, "", ""), (8, 10, 104, 5, "", ""), (8, 10, 104, 6, "", ""), (9, None, 101, 5, "", "")]
    parents = [(100, None, 1), (101, 10, 1), (102, 11, 1), (103, None, 9), (None, None, 1), (100, None, 2)]
    s = states(spark, refs, parents)
    got = {(r["ref_id"], r["state"]) for r in s.collect()}
    assert got == {(1, "valid"), (2, "deleted"), (3, "valid"), (4, "late"), (8, "missing"), (9, "valid")}
    assert rows(R.orphans(s)) == [("t", "parent", 2, 10), ("t", "parent", 8, 10)]
    rep = {r["snap_step"]: (r["n_refs"], r["n_missing"], r["n_deleted"], r["n_late"]) for r in R.orphan_report(s).collect()}
    assert rep == {10: (5, 1, 1, 1), None: (1, 0, 0, 0)}


def test_parent_that_came_back(spark):
    refs = [(i, step, 100 + i % 2, 5, "", "") for i, step in enumerate((9, 9, 12, 12, 25, 25))]
    parents = [(100, 10, 1), (100, 20, 2), (101, 10, 1), (101, None, 2)]
    assert {(r["ref_id"], r["state"]) for r in states(spark, refs, parents).collect()} == {(0, "valid"), (1, "valid"), (2, "valid"), (3, "valid"), (4, "deleted"), (5, "valid")}


def test_reference_empty_tables(spark):
    assert states(spark, [], []).count() == 0
    assert [r["state"] for r in states(spark, [(1, 1, 5, 1, "", "")], []).collect()] == ["missing"]


def test_parent_without_arrival_time_exists(spark):
    assert [r["state"] for r in states(spark, [(1, 1, 5, 1, "", "")], [(5, None, None)]).collect()] == ["valid"]


def test_cell_masses_of_distinct_members(spark, tmp_path):
    from nebulith.plans import dealt

    members = [(5, 1, 0, 10, 1), (5, 1, 0, 10, 2), (5, 1, 1, 11, 1), (5, 1, 2, 12, 1), (6, 1, 3, 13, 1), (6, 2, 0, 99, 1), (None, 2, 1, 14, 1)]
    particles = [(10, 1.5, 1), (10, 1.5, 7), (11, 2.0, 1), (12, float("nan"), 1), (13, None, 1), (14, 4.0, 1), (15, 8.0, 1)]
    spark.createDataFrame(members, "cell_key long, snap_step long, local_index long, particle_id long, ingested_at int").write.parquet(f"{tmp_path}/cell_members.parquet")
    spark.createDataFrame(particles, "particle_id long, mass double, ingested_at int").write.parquet(f"{tmp_path}/particles.parquet")
    got = {r["cell_key"]: (r["n_members"], r["n_masses"], r["mass"]) for r in dealt.QUERIES["p6_cell_masses"](spark, str(tmp_path)).collect()}
    assert got == {5: (3, 2, 3.5), 6: (2, 0, None), None: (1, 1, 4.0)}


def test_largest_gap_of_all_species(spark, tmp_path):
    import __spark_entry__ as entry

    rng = random.Random(8)
    data = [(i, rng.randrange(1, 3), rng.choice([0, 1, 3]), rng.uniform(-20, 130), 1) for i in range(300)] + [(300, 1, 3, float("nan"), 1), (301, 1, 0, None, 1), (302, 3, 1, 7.0, 1)]
    spark.createDataFrame(data + data[:20], "particle_id long, snap_step long, species_tag int, x double, ingested_at int").write.parquet(f"{tmp_path}/particles.parquet")
    want = {}
    for step in (1, 2, 3):
        xs = sorted(x % 100.0 for _, s, _, x, _ in data if s == step and x is not None and x == x)
        want[step] = max(b - a for a, b in zip(xs, [*xs[1:], xs[0] + 100.0]))
    got = dict(rows(entry.queries()["so05_largest_gap_all"](spark, str(tmp_path))))
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-8 for s in want)
