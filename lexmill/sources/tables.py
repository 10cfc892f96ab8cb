"""Readers and sinks for the corpus tables (parquet, JSONL, CSV, HTML folders, XML sitemaps)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions import urls as U

INVENTORY_SCHEMA = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("size", T.LongType()),
    ]
)

CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("section_heading", T.StringType()),
        T.StructField("breadcrumb", T.StringType()),
        T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField("heading_prefix", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("chunk_total", T.IntegerType()),
        T.StructField("approx_tokens", T.IntegerType()),
    ]
)

DOCUMENT_SCHEMA = T.StructType(
    [
        *(T.StructField(name, T.StringType()) for name in ("id", "title", "url", "section_heading", "breadcrumb", "keywords", "embed_text", "text")),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("chunk_total", T.IntegerType()),
    ]
)

QUESTION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        *(T.StructField(name, T.StringType()) for name in ("question", "tier", "category")),
        *(T.StructField(name, T.ArrayType(T.StringType())) for name in ("expected_url_contains", "expected_answer_contains")),
        T.StructField("ground_truth", T.StringType()),
    ]
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder; ``<name>.parquet`` may be a file or a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_inventory_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an inventory CSV whose page was saved (non-empty ``filename``)."""
    rows = spark.read.schema(INVENTORY_SCHEMA).csv(path, header=True, multiLine=True, escape='"')
    return rows.where(F.coalesce(F.col("filename"), F.lit("")) != "")


def read_chunks_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines; blank lines are skipped, missing fields are null."""
    return spark.read.schema(CHUNK_SCHEMA).json(path)


def read_docs_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Documents to index from JSON lines; those without text are left out, missing fields are empty, and a document
    without ``embed_text`` is embedded by its text."""
    rows = spark.read.schema(DOCUMENT_SCHEMA).json(path).where(F.coalesce(F.col("text"), F.lit("")) != "")
    filled = rows.fillna("", ["title", "url", "section_heading", "breadcrumb", "keywords"])
    return filled.withColumn("embed_text", F.coalesce(F.nullif("embed_text", F.lit("")), F.col("text")))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(qid, question, tier, category, fragments, answer_words, ground_truth) of a JSON file with a list of questions."""
    rows = spark.read.schema(QUESTION_SCHEMA).json(path, multiLine=True).where(F.col("id").isNotNull())
    return rows.select(F.col("id").cast("long").alias("qid"), "question", "tier", "category", F.col("expected_url_contains").alias("fragments"), F.col("expected_answer_contains").alias("answer_words"), "ground_truth")


def write_report(report: DataFrame, path: str) -> None:
    """Writes a report of one row as one JSON document into the folder ``path``."""
    report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).coalesce(1).write.mode("overwrite").text(path)


def read_html_folder(spark: SparkSession, path: str) -> DataFrame:
    """(filename, html) for every file of a folder; bytes that are not UTF-8 become replacement marks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("html"),
    )


def read_sitemap(spark: SparkSession, path: str, host: str) -> DataFrame:
    """Distinct page addresses of an XML sitemap, made https, on one host, in order."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc STRING").load(path)
    https = F.regexp_replace(F.trim("loc"), "^[A-Za-z]+://", "https://")
    return rows.select(https.alias("url")).where(F.try_parse_url("url", F.lit("HOST")) == host).distinct().orderBy("url")


def seeds(addresses: DataFrame, prefix: str, disallowed: DataFrame | None = None) -> DataFrame:
    """(url): where a crawl begins: the sitemap's addresses below a path prefix, without those that ``disallowed`` (path;
    path prefixes of the host's robots rules, a short list) forbids."""
    rows = addresses.where(U.under_prefix(F.col("url"), prefix)).select("url").distinct()
    if disallowed is None:
        return rows
    rules = disallowed.where(F.coalesce(F.col("path"), F.lit("")) != "").select(F.col("path").alias("__rule"))
    return rows.join(rules, U.path(F.col("url")).startswith(F.col("__rule")), "left_anti")


def site_of(url: Column) -> Column:
    """Host name of an address in lower case; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Append inventory rows to a CSV folder."""
    df.select(INVENTORY_SCHEMA.fieldNames()).write.mode("append").option("header", "true").csv(path)
