"""Fusing, adjusting, grouping, reranking and diversifying candidates of a batch of queries.

Candidates are rows (qid, idx, ..., score, pos); pos is the order in which they stand, and settles ties. All windows
run by qid over at most a few dozen candidates each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.config import Settings
from lexmill.functions import text as X
from lexmill.functions import vectors as V


def reciprocal_rank(dense: DataFrame, sparse: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(qid, idx, dense_score, bm25_score, score, pos): weighted reciprocal ranks added up, dense order before sparse."""
    s = settings or Settings.from_env()
    d = dense.select("qid", "idx", "dense_score", F.col("rank").alias("d"))
    b = sparse.select("qid", "idx", "bm25_score", F.col("rank").alias("s"))
    score = F.coalesce(F.lit(s.dense_weight) / (s.rrf_k + F.col("d")), F.lit(0.0)) + F.coalesce(F.lit(s.sparse_weight) / (s.rrf_k + F.col("s")), F.lit(0.0))
    both = d.join(b, ["qid", "idx"], "full").withColumn("score", F.round(score, 9))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("d"), F.asc_nulls_last("s"))
    return both.withColumn("pos", F.row_number().over(order)).drop("d", "s")


def hybrid(dense: DataFrame, sparse: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Fused candidates; a query without sparse hits keeps its dense hits with their dense scores."""
    fused = reciprocal_rank(dense, sparse, settings)
    any_sparse = F.count("bm25_score").over(Window.partitionBy("qid")) > 0
    return fused.withColumn("score", F.when(any_sparse, F.col("score")).otherwise(F.col("dense_score")))


def _replaced(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))


def adjusted(candidates: DataFrame, narrow_paths: list[str] = (), narrow_terms: list[str] = (), broad_paths: list[str] = (), settings: Settings | None = None) -> DataFrame:
    """Scores raised for words shared by query and title, lowered for narrow paths unless the query names one of the
    narrow terms, raised for broad paths. ``candidates`` has query, title and url."""
    s = settings or Settings.from_env()
    asked = F.array_distinct(X.words(F.lower(F.coalesce("query", F.lit("")))))
    shared = F.size(F.array_intersect(asked, F.array_distinct(X.words(F.lower(F.coalesce("title", F.lit("")))))))
    boost = F.when(shared >= 2, s.title_boost).when((shared == 1) & (F.size(asked) <= 4), s.title_boost_one).otherwise(0.0)
    url = F.lower(F.coalesce("url", F.lit("")))
    contains_any = lambda parts: F.greatest(*[F.contains(url, F.lit(p.lower())).cast("int") for p in parts], F.lit(0), F.lit(0)) == 1
    if narrow_paths:
        named = F.rlike(F.lower(F.coalesce("query", F.lit(""))), F.lit(r"\b(?:" + "|".join(t.lower() for t in narrow_terms) + r")\b")) if narrow_terms else F.lit(False)
        boost = boost - F.when(contains_any(narrow_paths) & ~named, s.path_penalty).otherwise(0.0)
    if broad_paths:
        boost = boost + F.when(contains_any(broad_paths), s.path_boost).otherwise(0.0)
    return _replaced(candidates.withColumn("score", F.round(F.col("score") + boost, 9)), F.desc("score"), F.col("pos"))


def grouped_by_url(candidates: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The best of each address, addresses in order of their best candidate."""
    s = settings or Settings.from_env()
    by_url = Window.partitionBy("qid", "url")
    score = F.coalesce("score", F.lit(0.0))
    ranked = candidates.withColumn("__n", F.row_number().over(by_url.orderBy(score.desc(), "pos"))).withColumn("__top", F.max(score).over(by_url)).withColumn("__first", F.min("pos").over(by_url))
    return _replaced(ranked.where(F.col("__n") <= s.max_per_url), F.desc("__top"), F.col("__first"), F.col("url"), F.col("__n")).drop("__n", "__top", "__first")


def word_overlap(query: Column, text: Column) -> Column:
    """Stand-in for a pair scorer: the share of the query's distinct words that stand in the text."""
    asked = F.array_distinct(X.words(F.lower(F.coalesce(query, F.lit("")))))
    there = F.array_distinct(X.words(F.lower(F.coalesce(text, F.lit("")))))
    return F.coalesce(F.size(F.array_intersect(asked, there)) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0))


def weighted_overlap(weights: Column, *texts: Column, scale: float = 10.0) -> Column:
    """Pair scores without a model, on the scale of a cross-encoder's logits: from -scale, where no term of the query
    stands in the texts, to scale, where all do; terms weigh by their inverse frequency. 0 for a query without terms."""
    there = F.split(F.lower(F.concat_ws(" ", *texts)), r"(?U)\s+")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, w: s + w["idf"])
    # by hash, so that each word of the texts is looked at once and not once a term; bound by a lambda, so that this is done
    # once and not once a term
    common = F.array_intersect(F.transform(weights, lambda w: w["term"]), there)
    met = F.get(F.transform(F.array(common), lambda t: total(F.filter(weights, lambda w: F.array_contains(t, w["term"])))), F.lit(0))
    share = met / total(weights)
    return F.coalesce(F.round(scale * (2 * share - 1), 6), F.lit(0.0))


def reranked(candidates: DataFrame, pair_score: Column, settings: Settings | None = None, cap: bool = True) -> DataFrame:
    """rerank_score: the pair scorer's value blended with the score scaled to 0..1 over the query's candidates (0.5 if
    all are equal), sorted by it and cut to the cap."""
    s = settings or Settings.from_env()
    whole = Window.partitionBy("qid")
    low, high = F.min("score").over(whole), F.max("score").over(whole)
    scaled = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(0.5)
    blended = candidates.withColumn("rerank_score", F.round(s.reranker_weight * pair_score + (1 - s.reranker_weight) * scaled, 9))
    rows = _replaced(blended, F.desc("rerank_score"), F.col("pos"))
    return rows.where(F.col("pos") <= s.rerank_cap) if cap else rows


def mmr(candidates: DataFrame, vec_col: str = "vec", settings: Settings | None = None) -> DataFrame:
    """The final_topk candidates by marginal relevance: the most relevant first, then the one that gains most when its
    greatest likeness to those chosen is taken off; ties by pos. ``pick`` numbers them from 1.

    One ordered fold over each query's array of candidates. Relevance is rerank_score, or score where there is none.
    """
    s = settings or Settings.from_env()
    rel = F.coalesce("rerank_score", "score") if "rerank_score" in candidates.columns else F.col("score")
    keep = [c for c in candidates.columns if c not in ("qid", vec_col)]
    packed = candidates.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("__pos"), rel.cast("double").alias("__rel"), F.col(vec_col).alias("__vec"), F.struct(*keep).alias("__row")))).alias("all"))

    def gain(x: Column, chosen: Column) -> Column:
        like = F.array_max(F.transform(chosen, lambda c: F.coalesce(V.dot(c["__vec"], x["__vec"]), F.lit(0.0))))
        return F.round(F.when(F.size(chosen) == 0, x["__rel"]).otherwise(s.mmr_lambda * x["__rel"] - (1 - s.mmr_lambda) * like), 9)

    def step(chosen: Column, _: Column) -> Column:
        rest = F.filter("all", lambda x: ~F.exists(chosen, lambda c: c["__pos"] == x["__pos"]))
        best = F.array_max(F.transform(rest, lambda x: F.struct(gain(x, chosen).alias("g"), (-x["__pos"]).alias("p"))))
        # bound by a lambda, so that the best is found once a step and not once a candidate; none is left where it is null
        return F.concat(chosen, F.flatten(F.transform(F.array(best), lambda b: F.filter("all", lambda x: x["__pos"] == -b["p"]))))

    none = F.filter("all", lambda x: F.lit(False))
    picks = packed.withColumn("chosen", F.aggregate(F.sequence(F.lit(1), F.lit(s.final_topk)), none, step))
    return picks.select("qid", F.posexplode("chosen").alias("__k", "x")).select("qid", (F.col("__k") + 1).alias("pick"), "x.__row.*")
