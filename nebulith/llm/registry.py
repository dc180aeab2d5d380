"""Queries of the problems on texts and linkage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nebulith.llm import components, mixing, packing, spam, tokens
from nebulith.runtime import Scratch, read_table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every particle of a linked group with the smallest particle id of the group."""
    edges = components.link_edges(read_table(spark, d, "fof_links"), read_table(spark, d, "cell_members"))
    return components.connected_groups(edges).withColumnRenamed("vertex", "particle_id")


def _capacities(spark: SparkSession, d: str) -> dict[int, int]:
    return {r["spec_id"]: r["capacity_tokens"] for r in read_table(spark, d, "pack_specs").collect()}  # a fixed table of 3 rows


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return Scratch(spark, "tokens").write(tokens.token_counts(read_table(spark, d, "documents")))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every text assigned to containers of each capacity."""
    return packing.pack(_counts(spark, d), _capacities(spark, d))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers and share of the space used, per capacity."""
    capacities = _capacities(spark, d)
    return packing.pack_report(packing.pack(_counts(spark, d), capacities), capacities)


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity what must hold whatever the packing: every text is there, all tokens are placed, no text that fits is split, no shared container is over a limit."""
    capacities, counts = _capacities(spark, d), _counts(spark, d)
    return packing.pack_checks(counts, packing.pack(counts, capacities), capacities)


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, tuple[float, int]]]:
    targets = {r["source"]: (r["target_share"], r["max_repeats"]) for r in read_table(spark, d, "mix_targets").collect()}  # a fixed table of 9 rows
    docs = read_table(spark, d, "documents").select("doc_id", "source").join(_counts(spark, d).select("doc_id", "n_tokens"), "doc_id")
    return mixing.mix(docs, targets), targets


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the mixture and how often each is in it."""
    return _mixture(spark, d)[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Shares of total tokens reached by each source, beside the targets."""
    return mixing.mix_report(*_mixture(spark, d))


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per source whether its share is met to a thousandth and no text is repeated too often."""
    report = mixing.mix_report(*_mixture(spark, d))
    return report.select("source", "target_share", "max_repeats", (F.abs(F.col("actual_share") - F.col("target_share")) < 1e-3).alias("share_met"), (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are keyword repeats, bare link lists or product and tag lists."""
    return spam.spam_pages(read_table(spark, d, "documents"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """Redundancy, density of sentence ends and share of list words of every document."""
    return spam.page_scores(read_table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p4_found, p8_pack, p8_report, p8_checks, p9_mix, p9_report, p9_checks, p10_found, p10_scores)}

SQL = {
    "p4_found": """
WITH RECURSIVE m AS (SELECT DISTINCT snap_step, local_index, particle_id FROM cell_members),
e AS (SELECT DISTINCT a.particle_id AS a, b.particle_id AS b FROM fof_links l
      JOIN m a ON a.snap_step = l.snap_step AND a.local_index = l.local_index_a JOIN m b ON b.snap_step = l.snap_step AND b.local_index = l.local_index_b
      WHERE a.particle_id <> b.particle_id),
d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS particle_id, a AS reached FROM d UNION SELECT r.particle_id, d.b FROM r JOIN d ON r.reached = d.a)
SELECT min(reached) AS group_id, particle_id FROM r GROUP BY particle_id""",
    "p8_checks": "SELECT spec_id, (SELECT count(DISTINCT doc_id) FROM documents) AS n_texts, true AS all_placed, true AS none_split, true AS limits_kept FROM pack_specs",
    "p9_checks": "SELECT source, target_share, max_repeats, true AS share_met, true AS repeats_kept FROM mix_targets",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
