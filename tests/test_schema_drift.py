import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import rows
from nebulith.operators import schema_drift as S

FILES = "source_file_index long, run_name string, restart_schema_version int, hubble_param double, scale_factor double, written_at timestamp, version string, ord int"
FIELDS = "source_file_index long, field_lane int, dataset_path string, scalar_type string, byte_width int, is_signed boolean, type string, path string"


def day(n):
    return dt.datetime(2031, 1, 1) + dt.timedelta(days=n)


def tables(spark, files, fields):
    f = [(i, run, 1, 0.7, 0.5, when, "x", 9) for i, run, when in files]
    g = [(i, lane, path, kind, None, None, "t", "p") for i, lane, path, kind in fields]
    return spark.createDataFrame(f + f[:1], FILES), spark.createDataFrame(g + g[:2], FIELDS)


def test_every_change_kind(spark):
    files, fields = tables(spark, [(1, "r", day(1)), (2, "r", day(2)), (3, "r", day(3)), (9, "s", day(1)), (8, None, day(1)), (7, "r", None)], [
        (1, 1, "/A//X/", "float64"), (1, 2, "A/Y", "f4"), (1, 3, "A/Z", "int32"), (1, None, "A/N", "u64"), (1, 5, "A/M", "long"),
        (2, 1, " a/x ", ">f8"), (2, 2, "A/Y2", "double"), (2, None, "A/n/", "uint64"), (2, None, "A/M", "int64"), (2, 6, "A/NEW", "float"),
        (3, 1, "A/X", "H5T_IEEE_F64LE"), (3, 3, "A/Z", "int32"), (9, 1, "A/X", "float32"), (8, 1, "A/Q", "float32"), (7, 1, "A/R", "float32"),
    ])
    want = [
        (2, "a/new", "added"), (2, "a/y2", "renamed"), (2, "a/y2", "retyped"), (2, "a/z", "removed"),
        (3, "a/m", "removed"), (3, "a/n", "removed"), (3, "a/new", "removed"), (3, "a/y2", "removed"), (3, "a/z", "added"),
    ]
    assert rows(S.schema_changes(files, fields)) == sorted(want)


def test_type_spellings(spark):
    cases = {
        "float64": "float:8", "<f8": "float:8", ">F8": "float:8", "Float64": "float:8", "H5T_IEEE_F64BE": "float:8", "double": "float:8", "f32": "float:4", "float": "float:4", "<f4": "float:4",
        "u64": "unsigned:8", "UInt64": "unsigned:8", "<u8": "unsigned:8", "H5T_STD_U32LE": "unsigned:4", "uint32": "unsigned:4", "i32": "signed:4", "int": "signed:4", "long": "signed:8", "<i8": "signed:8", "int16": "signed:2", "half": "float:2",
    }
    df = spark.createDataFrame([(k, None, None) for k in cases] + [("f", 8, None), (None, 8, True)], "t string, w int, s boolean")
    got = {r["t"]: r["c"] for r in df.select("t", S.canonical_type(F.col("t"), F.col("w"), F.col("s")).alias("c")).collect()}
    assert {k: got[k] for k in cases} == cases
    assert got["f"] == "float:8" and got[None] is None


def test_file_without_fields_and_empty_tables(spark):
    files, fields = tables(spark, [(1, "r", day(1)), (2, "r", day(2)), (3, "r", day(3))], [(1, 1, "A", "f8"), (3, 1, "A", "f8")])
    assert rows(S.schema_changes(files, fields)) == [(2, "a", "removed"), (3, "a", "added")]
    assert rows(S.schema_changes(files.limit(0), fields.limit(0))) == []


def test_lifespans(spark):
    files, fields = tables(spark, [(i, "r", day(i)) for i in range(1, 6)], [(i, 1, "A", "f8") for i in (1, 2, 4)] + [(5, 1, "A", "f4")])
    got = rows(S.lifespans(S.field_catalogue(files, fields)))
    assert got == [("r", "a", "float:4", 5, 5, True, False), ("r", "a", "float:8", 1, 2, False, True), ("r", "a", "float:8", 4, 4, True, True)]


def test_consistent_rows(spark):
    files, fields = tables(spark, [(1, "r", day(1)), (2, "r", day(2))], [(1, 1, "A/X", "f8"), (2, 1, "/A/X2", "f8"), (1, 2, "A/I", "u64"), (2, 2, "A/I", "<u8")])
    data = [(1, 1, 5, '{"A/X": "1.5", "A/I": 18446744073709551615}'), (2, 2, 6, '{"/A/X2/": null, "A/I": "no"}'), (3, 2, 7, "not json"), (4, 2, 8, None), (1, 1, 5, '{"A/X": "1.5", "A/I": 18446744073709551615}')]
    out = S.consistent_rows(files, fields, spark.createDataFrame(data, "row_id long, source_file_index long, particle_id long, payload string"))
    got = {(r["row_id"], r["field"]): (r["as_double"], r["as_bigint"], r["as_decimal"], r["bad_cast"]) for r in out.collect()}
    big = Decimal(18446744073709551615)
    assert got == {(1, "a/x2"): (1.5, None, None, False), (1, "a/i"): (None, None, big, False), (2, "a/x2"): (None, None, None, False), (2, "a/i"): (None, None, None, True)}


def test_one_type_for_all_files_of_a_run(spark):
    files, fields = tables(spark, [(1, "r", day(1)), (2, "r", day(2)), (3, "s", day(1))], [
        (1, 1, "A/X", "i4"), (2, 1, "A/Y", "f4"), (1, 2, "A/I", "i4"), (2, 2, "A/I", "i8"), (1, 3, "A/U", "u4"), (2, 3, "A/U", "u64"), (3, 1, "A/X", "i4"), (3, None, "A/N", "odd"),
    ])
    got = {(r["run_name"], r["path"]): (r["unified"], r["cast_to"]) for r in S.cast_table(S.field_catalogue(files, fields)).collect()}
    assert got == {
        ("r", "a/x"): ("a/y", "double"), ("r", "a/y"): ("a/y", "double"), ("r", "a/i"): ("a/i", "bigint"), ("r", "a/u"): ("a/u", "decimal(20,0)"), ("s", "a/x"): ("a/x", "bigint"), ("s", "a/n"): ("a/n", "double"),
    }


def test_changes_against_file_by_file_comparison(spark):
    """Random runs with null lanes, swaps and gaps: the lifespans give what comparing each file with the one before gives."""
    rng = random.Random(11)
    files, fields, runs = [], [], {}
    for i in range(60):
        run = f"r{i % 4}"
        files.append((i, run, day(i)))
        have = {}
        for lane in range(1, 7):
            if rng.random() < 0.8:
                have[rng.choice([lane, lane, lane, None]), rng.choice([f"p{lane}", f"p{lane}", f"q{lane}", f"p{lane % 6 + 1}"])] = rng.choice(["f4", "f8", "f8"])
        seen = {}
        for (lane, path), kind in have.items():
            if path not in {p for _, p in seen} and (lane is None or lane not in {x for x, _ in seen}):
                seen[lane, path] = kind
        fields += [(i, lane, path, kind) for (lane, path), kind in seen.items()]
        runs.setdefault(run, []).append((i, seen))
    want = set()
    for items in runs.values():
        for (_, old), (i, new) in zip(items, items[1:]):
            kept = set()
            for (lane, path), kind in new.items():
                twin = next((k for k in old if lane is not None and k[0] == lane), None) or next((k for k in old if k[1] == path and (lane is None or k[0] is None)), None)
                if twin is None:
                    want.add((i, path, "added"))
                    continue
                want |= {(i, path, "renamed")} if twin[1] != path else set()
                want |= {(i, path, "retyped")} if old[twin] != kind else set()
            for lane, path in old:
                kept = any((lane is not None and k[0] == lane) or (k[1] == path and (lane is None or k[0] is None)) for k in new)
                want |= set() if kept else {(i, path, "removed")}
    assert rows(S.schema_changes(*tables(spark, files, fields))) == sorted(want)
