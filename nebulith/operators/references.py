"""References to records that do not exist: missing, deleted or late targets.

References and parent keys are co-partitioned on (kind, key) and sorted; one merge of the two
streams gives every reference its parent's validity interval [first_seen, removed_step).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nebulith.operators.skew import salted_left_join

NO_REFERENCE = (0, 4294967295)  # fixed marks, besides null


def parent_intervals(df: DataFrame, kind: str, key: str, removed: str = "removed_step", seen: str = "ingested_at") -> DataFrame:
    """One validity interval per key, the merge of those of its rows; copies of a row are reduced before the shuffle.

    Every row of a key is valid until its removal. So a parent that was removed and came back is valid until the last removal, and without
    end if a row of it was never removed.
    """
    return df.where(F.col(key).isNotNull()).groupBy(F.concat_ws(":", F.lit(kind), F.col(key)).alias("target")).agg(
        F.count("*").alias("copies"), F.when(F.count(removed) == F.count("*"), F.max(removed)).alias("removed_at"), F.min(seen).alias("first_seen")
    )


def references(df: DataFrame, table: str, field: str, kind: str, id_column: str, step: str = "snap_step", seen: str = "ingested_at") -> DataFrame:
    """Rows that do refer: null and the marks 0 and 4294967295 are no reference."""
    return df.where(F.col(field).isNotNull() & ~F.col(field).isin(*NO_REFERENCE)).select(
        F.lit(table).alias("ref_table"), F.lit(field).alias("ref_field"), F.col(id_column).alias("ref_id"), F.col(step).alias("snap_step"),
        F.col(field).alias("ref_key"), F.concat_ws(":", F.lit(kind), F.col(field)).alias("target"), F.col(seen).alias("referred_at"),
    )


def reference_states(refs: list[DataFrame], parents: list[DataFrame]) -> DataFrame:
    """Every reference with ``state``: missing, deleted, late or valid.

    deleted: the target's removed_step is at or before the referring step. late: it exists, but
    arrived after the referring row. A parent key with contradicting rows counts
    from its first arrival and as removed from the last removal, if all its rows were removed. Empty tables give no rows.
    """
    joined = salted_left_join(
        reduce(DataFrame.unionByName, refs), reduce(DataFrame.unionByName, parents), "target", "ref_id"
    )
    state = (
        F.when(F.col("copies").isNull(), "missing")
        .when(F.col("removed_at") <= F.col("snap_step"), "deleted")
        .when(F.col("first_seen") > F.col("referred_at"), "late")
        .otherwise("valid")
    )
    return joined.withColumn("state", state).drop("target", "copies")


def orphans(states: DataFrame) -> DataFrame:
    """Distinct references whose target is missing or was deleted; late targets exist."""
    return states.where(F.col("state").isin("missing", "deleted")).select("ref_table", "ref_field", "ref_id", "snap_step").distinct()


def orphan_report(states: DataFrame) -> DataFrame:
    """References per table, field and snapshot step, by state; rows sent twice count once."""
    once = states.groupBy("ref_table", "ref_field", "snap_step", "ref_id").agg(F.min("state").alias("state"))
    count = lambda s: F.sum(F.when(F.col("state") == s, 1).otherwise(0)).alias(f"n_{s}")
    return once.groupBy("ref_table", "ref_field", "snap_step").agg(F.count("*").alias("n_refs"), *[count(s) for s in ("missing", "deleted", "late")])
