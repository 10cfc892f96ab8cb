"""BM25: index tables and batch search.

The index is four tables: postings (idx, term, tf, dl: the document's length), document lengths, document frequencies and
one row of totals.
A batch of queries meets the postings of its own terms only, in slices of documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.config import Settings


@dataclass
class Index:
    postings: DataFrame
    lengths: DataFrame
    frequencies: DataFrame
    totals: DataFrame


def terms(text: Column) -> Column:
    """Lower-case words between white space; nothing else is changed."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda x: x != "")


def index(corpus: DataFrame) -> Index:
    """``corpus``: idx, text. A null text counts as empty; every row counts in the totals."""
    words = corpus.select("idx", terms(F.coalesce("text", F.lit(""))).alias("words"))
    dl = F.size("words").cast("long").alias("dl")
    # by term, which brings the equal words of a document together too, and is how they are saved and counted
    postings = words.select("idx", dl, F.explode("words").alias("term")).repartition("term").groupBy("idx", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
    lengths = words.select("idx", dl)
    return Index(postings, lengths, _frequencies(postings), _totals(lengths))


def _frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _totals(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count(F.lit(1)).alias("docs"), (F.sum("dl") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("avg_dl"))


def save(found: Index, folder: str) -> None:
    """Writes the index tables below ``folder``; postings and frequencies lie together by term and sorted by it, as they
    are once counted. Frequencies and totals are counted on what is written, so that texts are split no more."""
    read = found.postings.sparkSession.read
    by_term = lambda rows: rows.sortWithinPartitions("term")
    found.lengths.write.mode("overwrite").parquet(f"{folder}/lengths")
    _totals(read.parquet(f"{folder}/lengths")).write.mode("overwrite").parquet(f"{folder}/totals")
    by_term(found.postings).write.mode("overwrite").parquet(f"{folder}/postings")
    by_term(_frequencies(read.parquet(f"{folder}/postings"))).write.mode("overwrite").parquet(f"{folder}/frequencies")


def load(spark: SparkSession, folder: str) -> Index:
    return Index(*(spark.read.parquet(f"{folder}/{name}") for name in ("postings", "lengths", "frequencies", "totals")))


def inverse_frequency(docs: Column, n: Column) -> Column:
    return F.log((docs - n + 0.5) / (n + 0.5) + 1)


def query_weights(queries: DataFrame, found: Index) -> DataFrame:
    """(qid, weights): each query's distinct terms with their inverse frequencies, which are highest for unknown terms."""
    asked = queries.select("qid", F.explode(F.array_distinct(terms(F.coalesce("text", F.lit(""))))).alias("term"))
    known = asked.join(found.frequencies, "term", "left").crossJoin(F.broadcast(found.totals))
    weighed = known.select("qid", F.struct("term", inverse_frequency(F.col("docs"), F.coalesce("n", F.lit(0))).alias("idf")).alias("w"))
    return weighed.groupBy("qid").agg(F.array_sort(F.collect_list("w")).alias("weights"))


#: Documents of which only the highest score is looked at first.
_STRETCH = 64


def _scorer(k: int, qid: str, idx: str):
    """Best k documents of each query within one slice of documents: a query's terms add their gains to one array of the
    slice's documents, always in the order of the terms, so that equal documents have equal scores.

    Gains of a term that more than an eighth of the documents have lie in an array of all of them. The k-th highest of the
    stretches' highest scores is a bound that k documents reach, so only documents that reach it are ranked. Queries of the
    same terms are answered once.
    """

    def best(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        keys, doc = np.unique(held["idx"].to_numpy(), return_inverse=True)
        code, names = pd.factorize(held["term"])
        order = np.argsort(code, kind="stable")
        doc, gain = doc[order], held["gain"].to_numpy()[order]
        ends = np.cumsum(np.bincount(code, minlength=len(names)))
        asked = asked.assign(code=pd.Index(names).get_indexer(asked["term"]))
        asked = asked[asked["code"] >= 0].sort_values(["qid", "term"])
        codes, times = asked["code"].to_numpy(), asked["times"].to_numpy()
        out: list[tuple] = []
        score = np.zeros(-(-len(keys) // _STRETCH) * _STRETCH)
        whole: dict[int, np.ndarray] = {}
        known: dict[bytes, tuple] = {}
        for q, rows in asked.groupby("qid", sort=False).indices.items():
            name = codes[rows].tobytes() + times[rows].tobytes()
            if name in known:
                out.append((q, *known[name]))
                continue
            score[:] = 0
            for c, n in zip(codes[rows].tolist(), times[rows].tolist(), strict=True):
                at = slice(ends[c - 1] if c else 0, ends[c])
                if 8 * (at.stop - at.start) <= len(keys):
                    score[doc[at]] += n * gain[at]
                    continue
                if c not in whole:
                    whole[c] = np.zeros(len(score))
                    whole[c][doc[at]] = gain[at]
                score += whole[c] if n == 1 else n * whole[c]
            tops = score.reshape(-1, _STRETCH).max(axis=1)
            least = np.partition(tops, len(tops) - k)[len(tops) - k] - 2e-6 if len(tops) > k else 0
            hit = np.flatnonzero(score >= least) if least > 0 else np.flatnonzero(score)
            value = score[hit]
            if len(hit) > k:
                # rounding moves a score by half of 0.000001 at most
                near = value >= np.partition(value, len(hit) - k)[len(hit) - k] - 2e-6
                hit, value = hit[near], value[near]
            value = np.round(value, 6)
            top = np.lexsort((hit, -value))[:k]
            known[name] = keys[hit[top]], value[top]
            out.append((q, *known[name]))
        return pd.DataFrame({
            "qid": np.repeat(np.array([q for q, _, _ in out], asked["qid"].dtype), [len(i) for _, i, _ in out]),
            "idx": np.concatenate([i for _, i, _ in out] or [keys[:0]]),
            "bm25_score": np.concatenate([v for _, _, v in out] or [np.zeros(0)]),
        })

    return best, f"qid {qid}, idx {idx}, bm25_score double"


def search(queries: DataFrame, found: Index, k: int = 30, settings: Settings | None = None, slice_docs: int = 16384, slice_queries: int = 8192) -> DataFrame:
    """(qid, idx, bm25_score, rank): the k best documents of each query by score, ties by idx.

    ``queries``: qid, text. A term counts as often as it stands in the query. Documents without any are not given.
    Slices of about ``slice_docs`` documents meet slices of about ``slice_queries`` queries; each pair of slices is one
    group, which gives the best k of its documents, so that no row stands for a document that only shares a common word.
    """
    settings = settings or Settings.from_env()
    queries = queries.where("qid IS NOT NULL")
    asked = queries.select("qid", F.explode(terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
    # one row of totals, and the frequencies of the queries' own terms
    weights = (
        found.frequencies.join(asked.select("term").distinct(), "term", "left_semi")
        .crossJoin(F.broadcast(found.totals))
        .select("term", "avg_dl", inverse_frequency(F.col("docs"), F.col("n")).alias("idf"))
    )
    k1, b = settings.bm25_k1, settings.bm25_b
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avg_dl"))
    gain = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    gains = found.postings.where("idx IS NOT NULL").join(weights, "term").select("idx", "term", gain.alias("gain"))
    parts = lambda n, size: max(1, -(-n // size))
    held_parts, asked_parts = parts(found.totals.first().docs, slice_docs), parts(queries.count(), slice_queries)
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = gains.select("*", number("idx", held_parts).alias("held"), every(asked_parts).alias("asked"))
    wanted = asked.select("*", number("qid", asked_parts).alias("asked"), every(held_parts).alias("held"))
    kinds = dict(queries.dtypes)["qid"], dict(found.postings.dtypes)["idx"]
    scored = held.groupBy("held", "asked").cogroup(wanted.groupBy("held", "asked")).applyInPandas(*_scorer(k, *kinds))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bm25_score"), "idx"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
