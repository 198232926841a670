"""Cross-site boilerplate: lines that too many distinct sites share.

Per line hash the sites are gathered in a HyperLogLog sketch, which map tasks fill and the shuffle
merges. A line far from the threshold is decided by its estimate; one near it gets an exact
distinct count. Boilerplate lines are then removed from every document that holds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from engram.session import checkpoint

#: log2 of the sketch's buckets; a relative standard error of about 2.6 %.
LOG_BUCKETS = 11
#: Estimates within this share of the threshold are counted exactly (over ten standard errors).
NEAR = 0.3


def line_array(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\\n")


def line_hash(line: Column) -> Column:
    """Hash of a line without spaces around it; null for a blank one."""
    bare = F.btrim(line, F.lit(" \t\r\x0b\x0c"))
    return F.when(bare != "", F.xxhash64(bare))


def common_lines(docs: DataFrame, text: str = "text", site: str = "source", sites: int = 10) -> DataFrame:
    """``line`` (hash) of the lines found on at least ``sites`` distinct non-null sites."""
    rows = docs.where(F.col(site).isNotNull()).select(
        F.col(site).cast("string").alias("site"), F.explode(F.array_distinct(F.transform(line_array(text), line_hash))).alias("line")
    ).where("line IS NOT NULL")
    spread = checkpoint(
        rows.groupBy("line").agg(F.count("*").alias("c"), F.hll_sketch_agg("site", LOG_BUCKETS).alias("sketch"))
        .where(F.col("c") >= sites)  # a line on many sites occurs at least as often
        .select("line", F.hll_sketch_estimate("sketch").alias("estimate"))
    )
    clear = spread.where(F.col("estimate") >= sites * (1 + NEAR)).select("line")
    near = spread.where((F.col("estimate") >= sites * (1 - NEAR)) & (F.col("estimate") < sites * (1 + NEAR)))
    exact = rows.join(near.select("line"), "line", "left_semi").groupBy("line").agg(F.countDistinct("site").alias("n"))
    return clear.unionByName(exact.where(F.col("n") >= sites).select("line"))


def without_boilerplate(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", sites: int = 10
) -> DataFrame:
    """``doc_id, n_lines, n_removed, clean`` of every row of ``docs``.

    Lines end at newlines; blanks around a line don't count, blank lines are never boilerplate,
    and kept lines keep their form. A null text has no lines and stays null, an empty one is one
    blank line. Rows without a site add none to the spread but are cleaned. Repeated rows and ids
    are each returned. Other columns are ignored; an empty table gives none.
    """
    common = checkpoint(common_lines(docs, text, site, sites))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    held = (
        rows.where("id IS NOT NULL").select("id", F.explode(F.array_distinct(F.transform(line_array("text"), line_hash))).alias("line"))
        .where("line IS NOT NULL").join(common, "line", "left_semi").groupBy(F.col("id").alias("i")).agg(F.collect_set("line").alias("bad"))
    )
    found = rows.join(held, F.col("id") == F.col("i"), "left")
    lines = line_array("text")
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("bad", line_hash(x)), F.lit(False)))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    clean = F.when(F.col("bad").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    removed = F.when(F.col("bad").isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long")
    return found.select(F.col("id").alias(doc_id), n.alias("n_lines"), removed.alias("n_removed"), clean.alias("clean"))
