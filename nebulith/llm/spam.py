"""Keyword-stuffed pages, bare link lists and product or tag lists among documents.

Texts are compressed block by block, a block being a run of sentences or of text without sentence ends. A block's ratio is
divided by the median ratio of sentence blocks of its length and language over the whole corpus. Text without sentence ends counts as
a list where it is no less redundant than sentences are; sentences do only where they are extremely redundant. A page with more
than half of its words in such blocks is found. Pages near the limits are decided by the exact count of their words in lists.
Two passes over the texts, no shuffle of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nebulith.llm.spam_text import list_words, page_blocks
from nebulith.runtime import Scratch, ship

SPARSE = 1.0  # normalized ratio up to which text without sentence ends is a list
EXTREME = 0.7  # ... and up to which sentences are
SURE_BYTES = 128  # shorter blocks of sentences are not judged by their ratio
NUMBERS = 0.02  # sentences with more than this share of digits are reports: their ratio alone does not make them lists
DOUBT = 0.85  # normalized ratio up to which sentences that aren't lists by the rules above are in doubt
DOUBT_SHARE = 0.3  # pages with more than this share of their words in lists or doubtful blocks are counted exactly
SHARE = 0.5  # more than this share of the words in lists makes a case
OWN_SHARE = 1 / 1000  # languages with at least this share of all blocks have expected ratios of their own, so at most 1,000 do
OWN_BLOCKS = 20  # ... for the lengths of which they have this many blocks; the rest shares those of all languages
BINS = 400  # steps of a ratio in the histograms the medians come from


def _size_class(n: int) -> int:
    return min(int(math.log2(max(n, 1)) * 2), 24)


def language(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)), F.lit(""))


def expected_ratios(docs: DataFrame) -> dict[tuple[str, int], float]:
    """Median ratio of sentence blocks of each language and block size class over all documents; "*" stands for all languages.

    What goes to the driver is at most (1 / OWN_SHARE + 1) · 25 numbers.
    """
    spark = docs.sparkSession
    ship(spark)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells: dict[tuple[str, int, int], int] = {}
            for text, lang in zip(batch["text"], batch["lang"]):
                for n, _, ratio, _, _ in page_blocks(text, sentences_only=True)[1]:
                    at = (lang, _size_class(n), int(ratio * BINS))
                    cells[at] = cells.get(at, 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in cells.items()], columns=["lang", "size", "bin", "n"])

    parts = docs.where(F.length("text") > 0).select("text", language(F.col("lang")).alias("lang")).mapInPandas(measure, "lang string, size int, bin int, n long")
    cells = Scratch(spark, "ratios").write(parts.groupBy("lang", "size", "bin").agg(F.sum("n").alias("n")))
    median = (F.expr("percentile(bin, 0.5, n)") + 0.5) / BINS
    total = cells.agg(F.sum("n")).first()[0] or 0
    own = cells.groupBy("lang").agg(F.sum("n").alias("blocks")).where(F.col("blocks") >= total * OWN_SHARE).select("lang")
    by_lang = cells.join(own, "lang", "left_semi").groupBy("lang", "size").agg(F.sum("n").alias("n"), median.alias("m")).where(F.col("n") >= OWN_BLOCKS)
    pooled = cells.groupBy(F.lit("*").alias("lang"), "size").agg(F.sum("n").alias("n"), median.alias("m"))
    return {(r["lang"], r["size"]): r["m"] for r in by_lang.unionByName(pooled).collect()}


def page_scores(docs: DataFrame, table: dict[tuple[str, int], float] | None = None) -> DataFrame:
    """(doc_id, redundancy, density, redundant_share, flagged, list_share) of every document.

    redundancy is the least normalized block ratio, density the share of words in blocks with sentence ends, redundant_share that of words in
    redundant blocks without them and extremely redundant ones with them. flagged pages are near the limits: their list_share is counted.
    Null and empty texts have no blocks: redundancy, redundant_share and list_share null, not flagged. Whole texts are
    measured, however long. Rows without a doc_id are left out; a doc_id that comes twice has two rows.
    """
    table = expected_ratios(docs) if table is None else table

    ship(docs.sparkSession)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, lang in zip(batch["doc_id"], batch["text"], batch["lang"]):
                if not isinstance(text, str) or not text.strip():
                    out.append((doc, None, 0.0, None, False, None))
                    continue
                data, blocks = page_blocks(text)
                words = data + sum(b[1] for b in blocks)
                least, sure, doubt, finished = math.inf, 0, 0, 0
                for n, w, ratio, ended, digits in blocks:
                    size = _size_class(n)
                    x = ratio / (table.get((lang, size)) or table.get(("*", size)) or 1.0)
                    least = min(least, x)
                    finished += w * ended
                    sure += w * (x <= EXTREME and n >= SURE_BYTES and digits <= NUMBERS if ended else x <= SPARSE)
                    doubt += w * (not ended or x <= DOUBT)
                share = sure / words if words else 0.0
                flagged = share <= SHARE and doubt > DOUBT_SHARE * words
                listed, counted = list_words(text) if flagged else (0, 1)
                out.append((doc, least if blocks else None, finished / words if words else 0.0, share, flagged, listed / counted if counted else 0.0))
            yield pd.DataFrame(out, columns=["doc_id", "redundancy", "density", "redundant_share", "flagged", "list_share"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text", language(F.col("lang")).alias("lang")).mapInPandas(
        score, "doc_id long, redundancy double, density double, redundant_share double, flagged boolean, list_share double"
    )


def spam_pages(docs: DataFrame) -> DataFrame:
    """Ids of the pages of which more than half of the words stand in keyword, link, product or tag lists."""
    return page_scores(docs).where((F.col("redundant_share") > SHARE) | F.col("flagged") & (F.col("list_share") > SHARE)).select("doc_id").distinct()
