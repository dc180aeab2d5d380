"""Quantities recorded in different units, brought to SI.

A unit text, a factor or a unit inside the value decides where there is one. Where all are missing, a calibrated
tree ensemble predicts the unit from magnitude, source, category, the units of neighbouring fields and the same quantity's other readings;
confident predictions are used, the others are routed for review.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nebulith.functions.unit_text import parse_unit
from nebulith.operators.skew import heavy_values, salted_join
from nebulith.runtime import Scratch

MAX_LABELLED = 20_000  # labelled fields used to fit, drawn evenly from all by hash
MAX_CLASSES = 40  # most frequent units that have a class of their own
CONFIDENT = 0.9  # calibrated probability from which a prediction is used
FEATURES = ["offset", "has_offset", "magnitude", "has_magnitude", "cat_length", "cat_mass", "cat_speed", "source", "version", "h", "a", "near_cgs", "near_si", "near_astro", "near_factor"]


def _unit_parser(si: dict[str, float]):
    def parse(text: pd.Series) -> pd.DataFrame:
        units = {t: parse_unit(t, si) for t in text.dropna().unique()}
        got = [units.get(t) for t in text]
        return pd.DataFrame({"base": [u.base if u else None for u in got], "h": [u.h if u else 0.0 for u in got], "a": [u.a if u else 0.0 for u in got]}, dtype="float64")

    return F.pandas_udf(parse, "base double, h double, a double")


_NUMBER = r"(?sU)^\s*([+-]?(?:\d[\d.,]*|[.,]\d+)(?:[eE][+-]?\d+)?)(.*)$"


def number_text(text: Column) -> tuple[Column, Column]:
    """(number, unit text) of a reading's text. A comma is the decimal mark unless a point follows it (then it groups digits)."""
    digits, rest = F.regexp_extract(text, _NUMBER, 1), F.regexp_replace(F.regexp_extract(text, _NUMBER, 2), r"(?U)^\s+|\s+$", "")
    grouped = digits.rlike(r",[^,]*\.[^,]*$") | digits.rlike(r"^[^.]*,[^.]*,[^.]*$")
    plain = F.when(grouped, F.regexp_replace(digits, ",", "")).when(digits.contains(","), F.replace(F.regexp_replace(digits, r"\.", ""), F.lit(","), F.lit("."))).otherwise(digits)
    return plain.try_cast("double"), F.when(rest != "", rest)


def _real(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def field_units(fields: DataFrame, files: DataFrame, si: dict[str, float]) -> DataFrame:
    """One row per (file, path): base and exponents as the rules give them, base null where nothing tells.

    A unit that the text names beats the factor. Exponents that are not null beat the text's marks.
    Copies of a field count once; contradicting copies give the largest values.
    """
    once = fields.groupBy("source_file_index", "dataset_path").agg(
        F.max(_real(F.col("base_unit_to_si"))).alias("factor"), F.max(_real(F.col("hubble_exponent"))).alias("hx"), F.max(_real(F.col("scale_factor_exponent"))).alias("ax"),
        F.max("source_unit").alias("source_unit"), F.max("length_power").alias("lp"), F.max("mass_power").alias("mp"), F.max("time_power").alias("tp"),
    )
    about = files.groupBy("source_file_index").agg(
        F.max("hubble_param").alias("file_h"), F.max("scale_factor").alias("file_a"), F.max("run_name").alias("run_name"), F.max("restart_schema_version").alias("version")
    )
    parsed = once.withColumn("u", _unit_parser(si)("source_unit"))
    return parsed.join(about, "source_file_index", "left").select(
        "source_file_index", "dataset_path", "file_h", "file_a", "run_name", "version", "lp", "mp", "tp",
        F.coalesce("u.base", "factor").alias("base"), F.coalesce("hx", "u.h").alias("hx"), F.coalesce("ax", "u.a").alias("ax"),
        F.when(F.col("u.base").isNotNull(), "named").when(F.col("factor").isNotNull(), "factor").alias("origin"),
    )


def _known(units: DataFrame, numbered: DataFrame) -> DataFrame:
    """Readings beside their field's unit and file, with ``si``: the value where text, name or factor give a unit."""
    field = ["source_file_index", "dataset_path"]
    joined = salted_join(numbered, units.drop("run_name", "version", "lp", "mp", "tp"), field, ["reading_id"], heavy_values(numbered, field), "left")
    # the text's unit is used where stored_value is null, as only then the text holds the reading
    from_text = F.col("stored").isNull() & F.col("t_base").isNotNull()
    joined = joined.withColumns({
        "from_text": from_text, "hx": F.when(from_text, F.col("t_h")).otherwise(F.coalesce("hx", F.lit(0.0))), "ax": F.when(from_text, F.col("t_a")).otherwise(F.coalesce("ax", F.lit(0.0))),
        "base": F.when(from_text, F.col("t_base")).otherwise(F.col("base")),
    })
    return joined.withColumn("si", F.col("number") * F.col("base") * _scaling())


def _scaling() -> Column:
    power = lambda x, e: F.when(F.col(e) == 0, F.lit(1.0)).otherwise(F.pow(x, F.col(e)))
    return power("file_h", "hx") * power("file_a", "ax")


def _features(units: DataFrame, known: DataFrame) -> DataFrame:
    """One row per field with a length or a mass in its dimension: magnitude, source, category, the units of neighbouring fields, and how far
    its numbers are from the SI values of the same particle's and quantity's other readings (``offset``, the power of ten of the missing unit)."""
    sized = known.where(F.abs("number") > 0).withColumn("own", F.when(F.abs("si") > 0, F.log10(F.abs("si"))))
    others = sized.groupBy("particle_id", "quantity").agg(F.sum("own").alias("all_logs"), F.count("own").alias("n_logs"))
    met = salted_join(sized, others, ["particle_id", "quantity"], ["reading_id"], heavy_values(sized, ["particle_id", "quantity"]))
    mean = F.when(F.col("n_logs") > F.col("own").isNotNull().cast("int"), (F.col("all_logs") - F.coalesce("own", F.lit(0.0))) / (F.col("n_logs") - F.col("own").isNotNull().cast("int")))
    plain = ~F.col("from_text")  # readings in their own unit tell nothing about the field's
    sizes = met.groupBy("source_file_index", "dataset_path").agg(
        F.avg(F.when(plain, F.log10(F.abs("number")))).alias("magnitude"), F.avg(F.when(plain, mean - F.log10(F.abs("number")) - F.log10(_scaling()))).alias("offset"),
    )
    system = F.when(F.col("base").isin(1.0, 1000.0), "si").when(F.col("base").isin(0.01, 0.001), "cgs").when(F.col("base") > 1000, "astro")
    n = lambda s: F.sum(F.when(F.col("system") == s, 1).otherwise(0))
    tagged = units.withColumn("system", system).withColumn("dims", (F.col("lp") != 0) | (F.col("mp") != 0))
    near = tagged.groupBy("source_file_index").agg(n("cgs").alias("n_cgs"), n("si").alias("n_si"), n("astro").alias("n_astro"), F.count("base").alias("n_base"))
    joined = tagged.where("dims").join(near, "source_file_index").join(sizes, ["source_file_index", "dataset_path"], "left")
    mine = lambda s: F.when(F.col("system") == s, 1).otherwise(0)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return joined.select(
        "source_file_index", "dataset_path", "base",
        F.coalesce("offset", F.lit(0.0)).alias("offset"), flag(F.col("offset").isNotNull()).alias("has_offset"),
        F.coalesce("magnitude", F.lit(0.0)).alias("magnitude"), flag(F.col("magnitude").isNotNull()).alias("has_magnitude"),
        flag((F.col("lp") != 0) & (F.col("tp") == 0)).alias("cat_length"), flag(F.col("mp") != 0).alias("cat_mass"), flag((F.col("tp") != 0) & (F.col("mp") == 0)).alias("cat_speed"),
        F.pmod(F.xxhash64(F.regexp_extract(F.coalesce("run_name", F.lit("")), "^[a-z]+", 0)), F.lit(64)).cast("double").alias("source"),
        F.coalesce(F.col("version").cast("double"), F.lit(0.0)).alias("version"), F.coalesce("file_h", F.lit(0.0)).alias("h"), F.coalesce("file_a", F.lit(0.0)).alias("a"),
        (F.col("n_cgs") - mine("cgs")).cast("double").alias("near_cgs"), (F.col("n_si") - mine("si")).cast("double").alias("near_si"),
        (F.col("n_astro") - mine("astro")).cast("double").alias("near_astro"), (F.col("n_base") - F.col("base").isNotNull().cast("int")).cast("double").alias("near_factor"),
    )


@dataclass
class UnitModel:
    forest: RandomForestClassificationModel | None
    classes: list[float | None]  # the last stands for all rarer units: whatever it is given to goes to review
    knots: list[tuple[float, float]]  # calibration: raw vote share -> share that was right on held-out fields
    held_out: int
    accuracy: float

    def predict(self, features: DataFrame) -> DataFrame:
        """Adds ``predicted`` base and calibrated ``confidence``; without a model both are null."""
        if self.forest is None:
            return features.withColumns({"predicted": F.lit(None).cast("double"), "confidence": F.lit(None).cast("double")})
        out = self.forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features))
        votes = vector_to_array("probability")
        top = F.array_max(votes)
        confidence = F.lit(self.knots[0][1])
        for (x0, y0), (x1, y1) in zip(self.knots, self.knots[1:]):
            slope = (y1 - y0) / (x1 - x0) if x1 > x0 else 0.0
            confidence = F.when(top >= x0, F.least(F.lit(y0) + (top - x0) * slope, F.lit(max(y0, y1)))).otherwise(confidence)
        bases = F.array(*[F.lit(c).cast("double") for c in self.classes])
        return out.withColumns({"predicted": F.element_at(bases, F.col("prediction").cast("int") + 1), "confidence": confidence}).drop("features", "rawPrediction", "probability", "prediction")


def unit_class(base: Column) -> Column:
    return F.round(F.log10(base), 4)


def fit_units(features: DataFrame, max_labelled: int = MAX_LABELLED) -> UnitModel:
    """Random forest on a bounded sample of labelled fields; confidence calibrated by isotonic regression on a fourth held out.

    The MAX_CLASSES most frequent units have classes of their own. All rarer ones are one class without a unit: it takes part in the fit and
    in the calibration, where a rare unit taken for a frequent one counts as wrong, and what is given to it goes to review.
    """
    labelled = features.where(F.col("base").isNotNull()).withColumn("cls", unit_class(F.col("base")))
    every = labelled.groupBy("cls").agg(F.count("*").alias("n"), F.min("base").alias("base"))
    counts = every.orderBy(F.desc("n"), "cls").limit(MAX_CLASSES).collect()
    if len(counts) < 2:
        return UnitModel(None, [], [], 0, float("nan"))
    total = every.agg(F.sum("n")).first()[0]
    share = min(1.0, max_labelled / total)
    draw = F.pmod(F.xxhash64("source_file_index", "dataset_path"), F.lit(1_000_000))
    label = F.coalesce(F.create_map(*[F.lit(x) for i, r in enumerate(counts) for x in (r["cls"], float(i))])[F.col("cls")], F.lit(float(len(counts))))
    sample = labelled.where(draw < int(share * 1_000_000)).select(*FEATURES, label.alias("label"), (F.pmod(F.xxhash64("dataset_path", "source_file_index"), F.lit(4)) == 0).alias("held"))
    sample = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample).select("features", "label", "held").coalesce(4).cache()
    try:
        forest = RandomForestClassifier(numTrees=24, maxDepth=9, maxBins=64, seed=5, subsamplingRate=0.8, featureSubsetStrategy="0.6").fit(sample.where("NOT held"))
        judged = forest.transform(sample.where("held")).select(F.array_max(vector_to_array("probability")).alias("p"), (F.col("prediction") == F.col("label")).cast("double").alias("right"))
        n, accuracy = judged.agg(F.count("*"), F.avg("right")).first()
        if not n:
            return UnitModel(None, [], [], 0, float("nan"))
        curve = IsotonicRegression(featuresCol="p", labelCol="right").fit(judged)
        knots = list(zip(curve.boundaries.toArray().tolist(), curve.predictions.toArray().tolist()))
    finally:
        sample.unpersist()
    keep = sorted({*range(0, len(knots), max(1, len(knots) // 30)), len(knots) - 1})
    return UnitModel(forest, [*(r["base"] for r in counts), None], [knots[i] for i in keep], n, accuracy)


def si_readings(readings: DataFrame, fields: DataFrame, files: DataFrame, si: dict[str, float], confident: float = CONFIDENT, max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, UnitModel]:
    """Every reading with ``si_value``, ``origin`` (text, named, factor, predicted, review) and ``confidence``.

    Defined cases: copies of a reading count once; a reading without a number, or of a field that is not
    listed and without a unit in its text, gets a null value and origin ``review``, as do predictions below ``confident``;
    a missing h or a makes the value null only where its exponent is not 0; NaN counts as null; empty tables give no rows.
    """
    scratch = Scratch(readings.sparkSession, "units")
    numbered, units = scratch.write(_numbered(readings, si)), scratch.write(field_units(fields, files, si))
    known = scratch.write(_known(units, numbered))
    features = scratch.write(_features(units, known))
    model = fit_units(features, max_labelled)
    guessed = model.predict(features.where(F.col("base").isNull())).select("source_file_index", "dataset_path", "predicted", "confidence")
    about = files.groupBy("source_file_index").agg(F.max("hubble_param").alias("h2"), F.max("scale_factor").alias("a2"))
    out = known.join(guessed, ["source_file_index", "dataset_path"], "left").join(about, "source_file_index", "left")
    out = out.withColumns({"file_h": F.coalesce("file_h", "h2"), "file_a": F.coalesce("file_a", "a2"), "base": F.coalesce("base", F.when(F.col("confidence") >= confident, F.col("predicted")))})
    value = F.col("number") * F.col("base") * _scaling()
    origin = F.when(value.isNull(), "review").when(F.col("from_text"), "text").otherwise(F.coalesce("origin", F.lit("predicted")))
    scratch.drop(numbered, units)
    return out.select("reading_id", "particle_id", "quantity", value.alias("si_value"), origin.alias("origin"), F.when(~F.col("from_text"), F.col("confidence")).alias("confidence")), model


def _numbered(readings: DataFrame, si: dict[str, float]) -> DataFrame:
    once = readings.groupBy("reading_id", "particle_id", "quantity", "source_file_index", "dataset_path").agg(F.max(_real(F.col("stored_value"))).alias("stored"), F.max("stored_text").alias("text"))
    number, unit = number_text(F.col("text"))
    split = once.withColumns({"text_number": number, "unit_text": unit}).withColumn("t", F.when(F.col("unit_text").isNotNull(), _unit_parser(si)("unit_text")))
    return split.select(
        "reading_id", "particle_id", "quantity", "source_file_index", "dataset_path", "stored", F.coalesce("stored", "text_number").alias("number"),
        F.col("t.base").alias("t_base"), F.coalesce("t.h", F.lit(0.0)).alias("t_h"), F.coalesce("t.a", F.lit(0.0)).alias("t_a"),
    )


def hidden_unit_report(readings: DataFrame, fields: DataFrame, files: DataFrame, si: dict[str, float], confident: float = CONFIDENT, one_in: int = 10) -> DataFrame:
    """How well units are predicted: those of one in ``one_in`` fields (by hash of file and path) are hidden, text, factor and all, before the fit.

    Per true unit, and with unit null over all: hidden fields, those with readings, confident predictions, right ones among them,
    precision, coverage (confident of those with readings), mean confidence, and calibration error (mean confidence less precision). Fields without
    a length or mass in their dimension have no unit to predict. Without labelled fields there is no row.
    """
    scratch = Scratch(readings.sparkSession, "hidden")
    numbered = scratch.write(_numbered(readings, si))
    truth = scratch.write(field_units(fields, files, si))
    hide = F.pmod(F.xxhash64("dataset_path", "source_file_index", F.lit("hide")), F.lit(one_in)) == 0
    veil = {c: F.when(~hide, F.col(c)) for c in ("base_unit_to_si", "source_unit")}
    units = scratch.write(field_units(fields.withColumns(veil), files, si))
    features = scratch.write(_features(units, scratch.write(_known(units, numbered))))
    model = fit_units(features)
    was = truth.where(hide & F.col("base").isNotNull()).select("source_file_index", "dataset_path", unit_class(F.col("base")).alias("cls"), F.col("base").alias("unit"))
    judged = model.predict(features.where(F.col("base").isNull())).join(was, ["source_file_index", "dataset_path"])
    sure = F.col("predicted").isNotNull() & (F.col("confidence") >= confident)
    right = sure & (unit_class(F.col("predicted")) == F.col("cls"))
    judged = judged.select("unit", (F.col("has_magnitude") > 0).cast("int").alias("read"), sure.cast("int").alias("sure"), F.coalesce(right, F.lit(False)).cast("int").alias("right"), F.when(sure, F.col("confidence")).alias("p"))
    totals = judged.rollup("unit").agg(
        F.count("*").alias("n_hidden"), F.sum("read").alias("n_with_readings"), F.sum("sure").alias("n_confident"), F.sum("right").alias("n_right"), F.avg("p").alias("mean_confidence"),
        F.sum(F.col("sure") * F.col("read")).alias("_both"),
    ).where("n_hidden > 0")
    precision = F.try_divide("n_right", "n_confident")
    return totals.select("unit", "n_hidden", "n_with_readings", "n_confident", "n_right", precision.alias("precision"), F.try_divide("_both", "n_with_readings").alias("coverage"), "mean_confidence", (F.col("mean_confidence") - precision).alias("calibration_error"))


def disagreeing(values: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(particle_id, quantity) whose largest and smallest SI value differ by more than ``tolerance`` of the largest absolute value."""
    v = _real(F.col("si_value"))
    spread = values.groupBy("particle_id", "quantity").agg(F.max(v).alias("hi"), F.min(v).alias("lo"))
    return spread.where(F.col("hi") - F.col("lo") > tolerance * F.greatest(F.abs("hi"), F.abs("lo"))).select("particle_id", "quantity")
