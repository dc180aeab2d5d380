"""Batch job: tables under any of the known aliases to a published snapshot.

python -m nebulith.sources.convert INPUT OUTPUT --box 100 --step 1 [--species 0] [--mass 0.1]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nebulith.operators.state import periodic_wrap
from nebulith.sources import snapshots as S


def convert(df: DataFrame, box: float, species: int | None = None, mass: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(good records with canonical names, rejected ones with what is wrong). A missing species or mass takes the given one; positions are wrapped."""
    named = S.resolve_aliases(df, ("x", "y", "z", "vx", "vy", "vz", "particle_id"))
    if "species_tag" not in named.columns:
        if species is None:
            raise S.SnapshotError("the species is missing")
        named = named.withColumn("species_tag", F.lit(species))
    named = S.fill_missing(named, {"mass": ("default", mass) if mass is not None else ("reject", None)})
    wrapped = named.withColumns({c: periodic_wrap(F.col(c), box) for c in "xyz"}).withColumn("problems", S.record_problems(box))
    return wrapped.where(F.size("problems") == 0).drop("problems"), wrapped.where(F.size("problems") > 0)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--box", type=float, required=True)
    p.add_argument("--step", type=int, required=True)
    p.add_argument("--species", type=int)
    p.add_argument("--mass", type=float)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("convert").getOrCreate()
    good, bad = convert(spark.read.parquet(a.input), a.box, a.species, a.mass)
    S.write_snapshot(good, a.output, {"box": a.box, "step": a.step})
    print(f"{bad.count()} records were rejected")


if __name__ == "__main__":
    main()
