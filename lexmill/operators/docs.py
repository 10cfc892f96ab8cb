"""Preparing chunks as indexable documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as X


def prepared(chunks: DataFrame) -> DataFrame:
    """Valid chunks with keyword string and embedding text; rows without id or with short texts are left out."""
    return chunks.where((F.coalesce("id", F.lit("")) != "") & X.is_valid_text(F.col("text"))).select(
        "id",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("section_heading", F.lit("")).alias("section_heading"),
        F.coalesce("breadcrumb", F.lit("")).alias("breadcrumb"),
        X.keyword_string(F.col("keywords"), F.col("section_heading")).alias("keywords"),
        X.embed_text(F.coalesce("heading_prefix", "title"), F.col("text")).alias("embed_text"),
        "text",
        F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"),
        F.coalesce("chunk_total", F.lit(1)).alias("chunk_total"),
    )


def prep_stats(chunks: DataFrame) -> DataFrame:
    """(n_in, n_out, n_skipped) in one pass."""
    good = (F.coalesce("id", F.lit("")) != "") & X.is_valid_text(F.col("text"))
    return chunks.agg(F.count(F.lit(1)).alias("n_in"), F.count_if(good).alias("n_out")).withColumn("n_skipped", F.col("n_in") - F.col("n_out"))


def latest(chunks: DataFrame) -> DataFrame:
    """One delivery of each chunk, the one crawled last."""
    newest = F.max_by(F.struct(*[F.col(c) for c in chunks.columns if c != "id"]), F.coalesce("crawled_at", F.lit("1970-01-01").cast("timestamp")))
    return chunks.where("id IS NOT NULL").groupBy("id").agg(newest.alias("r")).select("id", "r.*")
