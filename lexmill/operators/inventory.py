"""Keeping the inventory of fetched pages: retries, duplicates, branch caps, page types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import urls as U


def failed(inventory: DataFrame) -> DataFrame:
    """Rows without a saved page."""
    return inventory.where(F.coalesce("filename", F.lit("")) == "")


def merged(original: DataFrame, retried: DataFrame, order: str = "fetched_at") -> DataFrame:
    """``original`` with each row of a retried address replaced by that address's last successful retry.

    Rows are matched by address; rows without one, and failed retries, change nothing. The original's ids stay.
    """
    fields = [c for c in ("status", "title", "filename", "size") if c in original.columns]
    last = (
        retried.where((F.coalesce("filename", F.lit("")) != "") & F.col("url").isNotNull())
        .groupBy("url")
        .agg(F.max_by(F.struct(*fields), F.struct(order, "inv_id")).alias("__new"))
    )
    rows = original.join(last, "url", "left")
    return rows.select(*[(F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)) for c in original.columns])


def first_of_content(pages: DataFrame, text_col: str, *order: str) -> DataFrame:
    """The first row of each text, by the hash of the text; null texts are left out."""
    rows = pages.where(F.col(text_col).isNotNull()).withColumn("content_hash", F.sha1(text_col))
    keep = F.min(F.struct(*order)).alias("__first")
    first = rows.groupBy("content_hash").agg(keep)
    return rows.join(first, "content_hash").where(F.struct(*order) == F.col("__first")).drop("__first").dropDuplicates(["content_hash"])


def capped_by_branch(pages: DataFrame, cap: int, *order: str, counts: Column | None = None) -> DataFrame:
    """The pages of each branch of a site, in order, that come before ``cap`` pages that count have come; branch_pos
    numbers them. Every page counts unless ``counts`` says which do, as a crawl counts first leaves with chunks."""
    by = Window.partitionBy("host", "branch").orderBy(*order)
    rows = pages.withColumn("host", U.authority(F.col("url"))).withColumn("branch", U.branch_key(F.col("url")))
    numbered = rows.withColumn("branch_pos", F.row_number().over(by))
    if counts is None:
        return numbered.where(F.col("branch_pos") <= cap)
    before = F.count_if(counts).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return numbered.withColumn("__before", F.coalesce(before, F.lit(0))).where(F.col("__before") < cap).drop("__before")


def typed(inventory: DataFrame, hubs: DataFrame, chunked: DataFrame) -> DataFrame:
    """``inventory`` with ``type``: fetch-error, blocked, hub, leaf-dup, leaf-empty or leaf."""
    hub = hubs.where("url IS NOT NULL").select("url").distinct().withColumn("__hub", F.lit(True))
    leaf = chunked.where("url IS NOT NULL").select("url").distinct().withColumn("__leaf", F.lit(True))
    first = inventory.where("url IS NOT NULL AND filename <> ''").groupBy("url").agg(F.min("inv_id").alias("__first"))
    rows = inventory.join(hub, "url", "left").join(leaf, "url", "left").join(first, "url", "left")
    kind = (
        F.when(F.coalesce("filename", F.lit("")) == "", F.when(F.lower(F.trim(F.coalesce("title", F.lit("")))) == "access denied", "blocked").otherwise("fetch-error"))
        .when(F.coalesce("__hub", F.lit(False)), "hub")
        .when(F.coalesce(F.col("inv_id") > F.col("__first"), F.lit(False)), "leaf-dup")
        .when(F.coalesce("__leaf", F.lit(False)), "leaf")
        .otherwise("leaf-empty")
    )
    return rows.withColumn("type", kind).drop("__hub", "__leaf", "__first")


def page_types(inventory: DataFrame, hubs: DataFrame, chunked: DataFrame) -> DataFrame:
    """(type, n) of the rows of the inventory, by ``typed``."""
    return typed(inventory, hubs, chunked).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def added_files(pages: DataFrame, more: DataFrame, key: str = "filename") -> DataFrame:
    """``pages`` and those of ``more`` whose file is not there yet."""
    return pages.unionByName(more.join(pages.select(key).distinct(), key, "left_anti"))
