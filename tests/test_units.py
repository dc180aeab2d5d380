import math

import pytest

from conftest import rows
from nebulith.functions.unit_text import parse_unit, split_number
from nebulith.operators import unit_harmony as U

SI = {"m": 1.0, "cm": 0.01, "km": 1e3, "pc": 3e16, "kpc": 3e19, "Mpc": 3e22, "g": 1e-3, "kg": 1.0, "Msun": 2e30, "s": 1.0, "yr": 3e7, "Gyr": 3e16}


@pytest.mark.parametrize("text,base,h,a", [
    ("kpc/h", 3e19, -1, 0), ("h^-1 kpc (comoving)", 3e19, -1, 1), ("ckpc h-1", 3e19, -1, 1), ("cm", 0.01, 0, 0), ("a*Mpc / h", 3e22, -1, 1), ("KPC comoving", 3e19, 0, 1), ("comoving megaparsec/h", 3e22, -1, 1),
    ("1e10 Msun/h", 2e40, -1, 0), ("10^{10} Msol h^-1", 2e40, -1, 0), ("1.0E+10 M_sun", 2e40, 0, 0), ("10^6 M_sun h-1", 2e36, -1, 0), ("1e10 solar masses / h", 2e40, -1, 0), ("solar mass", 2e30, 0, 0),
    ("km/s", 1e3, 0, 0), ("km s^-1", 1e3, 0, 0), ("km s-1 a^1/2", 1e3, 0, 0.5), ("kms^-1", 1e3, 0, 0), ("sqrt(a) kpc/Gyr", 1e3, 0, 0.5), ("a^0.5 km / s", 1e3, 0, 0.5), ("kpc Gyr^-1 * sqrt(a)", 1e3, 0, 0.5), ("[cm s^-1]", 0.01, 0, 0), ("m", 1.0, 0, 0), ("gram", 1e-3, 0, 0),
])
def test_named_units(text, base, h, a):
    u = parse_unit(text, SI)
    assert math.isclose(u.base, base, rel_tol=1e-12) and (u.h, u.a) == (h, a)


@pytest.mark.parametrize("text", ["code units", "internal", "", "dimensionless", "code/h", None, "???"])
def test_texts_that_name_none(text):
    assert parse_unit(text, SI).base is None


def test_marks_count_without_a_unit():
    assert parse_unit("code units h^-1 (comoving)", SI)[1:3] == (-1.0, 1.0)


@pytest.mark.parametrize("text,want", [("1,5 kpc", (1.5, "kpc")), ("+7619646 cm s^-1", (7619646.0, "cm s^-1")), ("-2,5e3\t[m]", (-2500.0, "[m]")), ("1.234,5", (1234.5, "")), ("1,234.5", (1234.5, "")), ("14.5507 1e10 Msun", (14.5507, "1e10 Msun")), ("no", (None, "no")), (None, (None, ""))])
def test_numbers(text, want):
    assert split_number(text) == want


READ = "reading_id long, particle_id long, quantity string, source_file_index long, dataset_path string, stored_value double, stored_text string, base double"
FIELD = "source_file_index long, dataset_path string, base_unit_to_si double, hubble_exponent double, scale_factor_exponent double, length_power int, mass_power int, time_power int, source_unit string, confidence string"
FILE = "source_file_index long, hubble_param double, scale_factor double, run_name string, restart_schema_version int"


def convert(spark, readings, fields, files, **kw):
    values, model = U.si_readings(spark.createDataFrame([(*r, 9.0) for r in readings], READ), spark.createDataFrame([(*f, "c") for f in fields], FIELD), spark.createDataFrame(files, FILE), SI, **kw)
    return {r["reading_id"]: (r["si_value"], r["origin"]) for r in values.collect()}, model, values


def test_rules(spark):
    files = [(1, 0.5, 0.25, "a_1", 1), (1, 0.5, 0.25, "a_1", 1)]
    fields = [
        (1, "named", 7.0, None, None, 1, 0, 0, "kpc/h"), (1, "factor", 3.0, -1.0, 1.0, 1, 0, 0, "code units"), (1, "both", 9.0, 0.0, 0.0, 1, 0, 0, "ckpc/h"), (1, "nothing", None, None, None, 1, 0, 0, None), (1, "nan", float("nan"), None, None, 0, 1, 0, "kg"),
    ]
    readings = [
        (1, 1, "position", 1, "named", 2.0, None), (2, 1, "position", 1, "factor", 2.0, None), (3, 1, "position", 1, "both", 2.0, None), (4, 1, "position", 1, "named", None, "2,5 [cMpc/h]"), (5, 1, "position", 1, "named", None, "4"),
        (6, 1, "position", 1, "unknown", 2.0, None), (7, 1, "mass", 1, "nan", 3.0, None), (8, 1, "mass", 1, "nan", None, None), (9, 1, "position", 1, "nothing", 2.0, None), (1, 1, "position", 1, "named", 2.0, None),
    ]
    got, _, values = convert(spark, readings, fields, files)
    want = {1: (2 * 3e19 * 2, "named"), 2: (2 * 3 / 0.5 * 0.25, "factor"), 3: (2 * 3e19, "named"), 4: (2.5 * 3e22 * 2 * 0.25, "text"), 5: (4 * 3e19 * 2, "named"), 6: (None, "review"), 7: (3.0, "named"), 8: (None, "review"), 9: (None, "review")}
    for k, (v, o) in want.items():
        assert got[k][1] == o and (v is None and got[k][0] is None or math.isclose(got[k][0], v, rel_tol=1e-12)), k
    assert rows(U.disagreeing(values)) == [(1, "position")]


def test_number_texts_in_columns_as_in_python(spark):
    from pyspark.sql import functions as F

    texts = ["1,5 kpc", "+7619646 cm s^-1", "-2,5e3\t[m]", "1.234,5", "1,234.5", "14.5507 1e10 Msun", "no", None, "", ".5", ",5 m", "1,2,3 km", "1.2.3", "7\u00a0kpc/h", "-1E-3"]
    number, unit = U.number_text(F.col("t"))
    got = {r["t"]: (r["n"], r["u"]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", number.alias("n"), unit.alias("u")).collect()}
    for t in texts:
        want = split_number(t)
        assert got[t][0] == want[0] and (want[0] is None or (got[t][1] or "") == want[1]), t


def test_rare_units_are_one_class_without_a_unit(spark, monkeypatch):
    """Units beyond the most frequent ones take part in fit and calibration; a field given to them goes to review."""
    monkeypatch.setattr(U, "MAX_CLASSES", 2)
    files = [(f, 0.7, 1.0, f"run_{f}", 3) for f in range(120)]
    bases = [(1.0, 1e22), (3e19, 300.0), (0.01, 1e24), (3e16, 3e5)]
    fields, readings = [], []
    for f in range(120):
        base, size = bases[0] if f % 6 in (0, 1) else bases[1] if f % 6 in (2, 3) else bases[2] if f % 6 == 4 else bases[3]
        fields.append((f, "/X", None if f >= 96 else base, 0.0, 0.0, 1, 0, 0, None))
        readings.append((f, f, "position", f, "/X", size * (1 + f % 7 / 10), None))
    got, model, _ = convert(spark, readings, fields, files)
    assert len(model.classes) == 3 and model.classes[-1] is None and model.held_out > 0
    assert {got[f][1] for f in range(96, 120) if f % 6 > 3} == {"review"}


def test_hidden_unit_report(spark):
    files = [(f, 0.7, 1.0, f"run_{f}", 3) for f in range(400)]
    fields, readings = [], []
    for f in range(400):
        for path, base in (("/X", (0.01, 1.0, 3e19)[f % 3]), ("/Y", (0.01, 1.0, 3e19)[f % 2])):
            fields.append((f, path, base, 0.0, 0.0, 1, 0, 0, None))
            readings.append((len(readings), f, "position", f, path, 3e21 / base, None))
    frames = spark.createDataFrame([(*r, 9.0) for r in readings], READ), spark.createDataFrame([(*f, "c") for f in fields], FIELD), spark.createDataFrame(files, FILE)
    report = {r["unit"]: r for r in U.hidden_unit_report(*frames, SI).collect()}
    assert set(report) == {None, 0.01, 1.0, 3e19}
    assert report[None]["n_hidden"] == sum(r["n_hidden"] for u, r in report.items() if u) and report[None]["precision"] > 0.98 and report[None]["coverage"] > 0.9
    assert U.hidden_unit_report(frames[0].limit(0), frames[1].limit(0), frames[2].limit(0), SI).count() == 0


def test_empty_tables(spark):
    got, model, values = convert(spark, [], [], [])
    assert got == {} and model.forest is None and rows(U.disagreeing(values)) == []


def test_disagreement_rule(spark):
    df = spark.createDataFrame([(1, "m", 100.0), (1, "m", 101.0), (2, "m", 100.0), (2, "m", 101.2), (3, "m", -100.0), (3, "m", -99.5), (4, "m", None), (4, "m", 1.0), (5, "m", float("nan")), (5, "m", 1.0), (6, "m", 0.0), (6, "m", 0.0)], "particle_id long, quantity string, si_value double")
    assert rows(U.disagreeing(df)) == [(2, "m")]


def test_predicted_units_on_held_out_fields(spark):
    """Fields whose unit is hidden: confident predictions must be right, the rest go to review."""
    import random

    rng = random.Random(4)
    files, fields, readings, truth = [], [], [], {}
    for f in range(260):
        system = rng.choice(["cgs", "si", "astro"])
        files.append((f, 0.7, 1.0, f"run_{f}", 3))
        for q, path in (("position", "/X"), ("mass", "/M"), ("speed", "/V")):
            base, mag = {"position": {"cgs": (0.01, 1e24), "si": (1.0, 1e22), "astro": (3e19, 300.0)}, "mass": {"cgs": (1e-3, 1e43), "si": (1.0, 1e40), "astro": (2e40, 1.0)}, "speed": {"cgs": (0.01, 1e7), "si": (1.0, 1e5), "astro": (1e3, 100.0)}}[q][system]
            hidden = rng.random() < 0.2
            fields.append((f, path, None if hidden else base, 0.0, 0.0, int(q != "mass"), int(q == "mass"), -int(q == "speed"), None))
            rid = len(readings)
            readings.append((rid, f, q, f, path, mag * rng.uniform(0.5, 2), None))
            if hidden:
                truth[rid] = readings[-1][5] * base
    got, model, _ = convert(spark, readings, fields, files)
    done = [(got[r][0], v) for r, v in truth.items() if got[r][1] == "predicted"]
    assert model.accuracy > 0.9 and len(done) > 0.6 * len(truth)
    assert sum(math.isclose(a, b, rel_tol=1e-9) for a, b in done) >= 0.95 * len(done)
    assert all(got[r][1] in ("predicted", "review") for r in truth)
