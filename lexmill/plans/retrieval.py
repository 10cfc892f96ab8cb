"""The retrieval pipeline over the indexed documents, for a batch of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.config import Settings
from lexmill.functions import vectors as V
from lexmill.operators import dense, fusion, sparse
from lexmill.session import ensure_checkpoint_dir, materialize
from lexmill.sources.tables import table


FIELDS = ["idx", "id", "title", "url", "section_heading", "breadcrumb", "keywords", "text", "vec"]


@dataclass(frozen=True)
class SearchIndex:
    """What a search reads: the documents' fields, their vectors as given and the sparse index."""

    docs: DataFrame
    vectors: DataFrame
    sparse: sparse.Index


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Indexed documents with their number and vector: one row per id of docvecs that docs has. Of several rows of one id
    the least in the order of its columns is taken. Few keys repeat, so rows are moved first and sorted once, where they meet."""
    docs = table(spark, folder, "docs")
    others = [c for c in docs.columns if c != "id"]
    first = docs.where("id IS NOT NULL").repartition("id").groupBy("id").agg(F.min(F.struct(*others)).alias("d")).select("id", "d.*")
    vecs = table(spark, folder, "docvecs").where("idx IS NOT NULL").repartition("idx").groupBy("idx").agg(F.min(F.struct("id", "vec")).alias("v")).select("idx", "v.id", "v.vec")
    return vecs.join(first, "id").select(FIELDS)


def build_index(docs: DataFrame) -> SearchIndex:
    """The index of documents (``FIELDS``, one row for each idx), as plans."""
    return SearchIndex(docs, docs.select("idx", "vec"), sparse.index(index_text(docs)))


def save_index(found: SearchIndex, folder: str) -> None:
    """Writes an index below ``folder``, to be read by any number of searches. Vectors lie with the documents, and the
    sparse index is made of these as written; both read only the columns they need."""
    found.docs.write.mode("overwrite").parquet(f"{folder}/docs")
    sparse.save(build_index(found.docs.sparkSession.read.parquet(f"{folder}/docs")).sparse, folder)


def load_index(spark: SparkSession, folder: str) -> SearchIndex:
    docs = spark.read.parquet(f"{folder}/docs")
    return SearchIndex(docs, docs.select("idx", "vec"), sparse.load(spark, folder))


#: Where the indexes lie that this application has built, by the folder of their tables.
_BUILT: dict[tuple[str, str], str] = {}


def session_index(spark: SparkSession, folder: str) -> SearchIndex:
    """The index of a data folder, which the first search of an application builds and saves beside its checkpoints."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _BUILT:
        place = f"{ensure_checkpoint_dir(spark)}/index-{key[0]}-{len(_BUILT)}"
        save_index(build_index(corpus(spark, folder)), place)
        _BUILT[key] = place
    return load_index(spark, _BUILT[key])


def index_text(docs: DataFrame) -> DataFrame:
    """(idx, text): keywords and lower-case title, which is what the sparse index holds."""
    return docs.select("idx", F.concat(F.coalesce("keywords", F.lit("")), F.lit(" "), F.lower(F.coalesce("title", F.lit("")))).alias("text"))


def _unit(size: int = 64):
    """The vector at length one; none for vectors of another length."""
    return F.when(F.size("vec") == size, V.unit(F.col("vec")))


def known_items(docs: DataFrame, every: int = 50) -> DataFrame:
    """The stated query set: rows whose number is divisible by ``every``; each asks with its heading and title."""
    asked = F.trim(F.concat(F.coalesce("section_heading", F.lit("")), F.lit(" "), F.coalesce("title", F.lit(""))))
    return docs.where(F.col("idx") % every == 0).select(F.col("idx").alias("qid"), asked.alias("text"), _unit().alias("vec"), "url", "keywords")


def legs(queries: DataFrame, found: SearchIndex, k: int) -> tuple[DataFrame, DataFrame]:
    """Dense and sparse hits of the queries (qid, text, vec)."""
    return dense.search(queries.select("qid", "vec"), found.vectors, k, unique=True, scale=True), sparse.search(queries.select("qid", "text"), found.sparse, k)


def candidates(queries: DataFrame, found: SearchIndex, settings: Settings | None = None) -> DataFrame:
    """Fused candidates of each query with title and address, the query's text and the pair score.

    A query's text and weights go to its candidates while these still lie by query, and the pair scores are made where the
    documents' texts are, so that texts are moved once and not once more for each candidate.
    """
    s = settings or Settings.from_env()
    fused = fusion.hybrid(*legs(queries, found, s.retriever_topk), s)
    weights = sparse.query_weights(queries.select("qid", "text"), found.sparse)
    asked = queries.select("qid", F.col("text").alias("query")).join(weights, "qid", "left")
    fields = found.docs.select("idx", "title", "url", "section_heading", "text")
    return fused.join(asked, "qid").join(fields, "idx").withColumn("pair", pair_score()).drop("weights", "section_heading", "text")


def with_vectors(rows: DataFrame, found: SearchIndex) -> DataFrame:
    """``rows`` with their documents' unit vectors; only their own are brought to length one."""
    return rows.join(found.docs.select("idx", "vec"), "idx").withColumn("vec", _unit())


def with_fields(picks: DataFrame, found: SearchIndex) -> DataFrame:
    """``picks`` with id, heading, breadcrumb and text. They are written once; while their keys are few by count, only the
    documents that are picked are moved."""
    picks = materialize(picks)
    fields = found.docs.select("idx", "id", "section_heading", "breadcrumb", "text")
    if picks.count() * 8 <= dense.BROADCAST_BYTES:
        fields = fields.join(F.broadcast(picks.select("idx").distinct()), "idx", "left_semi")
    return picks.join(fields, "idx")


def pair_score():
    """How well a candidate's title, heading and text answer its query."""
    return fusion.weighted_overlap(F.col("weights"), F.col("title"), F.col("section_heading"), F.col("text"))


def retrieve(queries: DataFrame, found: SearchIndex, settings: Settings | None = None) -> DataFrame:
    """(qid, pick, ...): hybrid search, adjustment, grouping by address, reranking, diversification."""
    s = settings or Settings.from_env()
    rows = fusion.grouped_by_url(fusion.adjusted(candidates(queries, found, s), settings=s), s)
    best = fusion.reranked(rows, F.col("pair"), s).drop("pair", "query")
    return with_fields(fusion.mmr(with_vectors(best, found), settings=s), found)


def multi_retrieve(requests: DataFrame, found: SearchIndex, settings: Settings | None = None) -> DataFrame:
    """(request, rank, ...): each request's sub-queries (request, part, text, vec) retrieved and merged; of results of
    the same address and beginning the first part's stays, and the best three more than final_topk are given."""
    s = settings or Settings.from_env()
    # the sub-queries' numbers go by request and part, whatever these are
    parts = materialize(requests.withColumn("qid", F.xxhash64("request", "part")))
    rows = retrieve(parts, found, s).join(parts.select("qid", "request", "part"), "qid")
    same = Window.partitionBy("request", "url", F.substring(F.coalesce("text", F.lit("")), 1, 100)).orderBy("part", "pick")
    once = rows.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")
    order = Window.partitionBy("request").orderBy(F.desc("rerank_score"), "part", "pick")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.final_topk + 3)


def prepared_corpus(spark: SparkSession, folder: str) -> tuple[SearchIndex, DataFrame]:
    """The folder's index and its known-item queries."""
    found = session_index(spark, folder)
    return found, known_items(found.docs)
