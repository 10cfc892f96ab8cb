"""Exact dense search of a stated query set against all rows, in blocks.

Queries and rows are gathered into blocks of vectors; every pair of a query block and a row block is one matrix
product in numpy (single precision, then double for the pairs that can count), of which a task keeps each query's best of all its blocks; the best of all tasks are merged by query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions import vectors as V


#: Bytes up to which the queries' vectors are sent to each task whole; beyond, blocks meet blocks by a plain product.
BROADCAST_BYTES = 32 << 20


def normalized(rows: DataFrame, vec_col: str = "vec") -> DataFrame:
    """``rows`` with unit vectors; rows whose vector has no direction are left out."""
    return rows.where(F.col(vec_col).isNotNull()).withColumn(vec_col, V.unit(F.col(vec_col))).where(F.col(vec_col).isNotNull())


def encoded(rows: DataFrame, text_col: str, encoder: Callable[[], Callable[[list[str]], np.ndarray]], size: int, batch: int = 256, vec_col: str = "vec") -> DataFrame:
    """``rows`` with ``vec_col``, the unit vector that an encoder gives for the text, null for null and empty texts.

    ``encoder`` is called once in each task and gives a function from texts to a matrix of ``size`` columns, which is
    asked for ``batch`` texts at a time; so a model is loaded by the tasks and no text leaves them.
    """
    base = rows.drop(vec_col)
    schema = T.StructType([*base.schema.fields, T.StructField(vec_col, T.ArrayType(T.FloatType()))])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for part in batches:
            out: list[np.ndarray | None] = [None] * len(part)
            at = [k for k, x in enumerate(part[text_col]) if x]
            texts = part[text_col].tolist()
            for s in range(0, len(at), batch):
                found = np.asarray(encode([texts[k] for k in at[s : s + batch]]), np.float64).reshape(-1, size)
                length = np.linalg.norm(found, axis=1)
                for k, v, n in zip(at[s : s + batch], found, length, strict=True):
                    out[k] = (v / n).astype(np.float32) if n > 0 else None
            yield part.assign(**{vec_col: pd.Series(out, index=part.index, dtype="object")})

    return base.mapInPandas(scan, schema)


def _units(data: np.ndarray) -> np.ndarray:
    """Rows at length one, as ``normalized`` gives them: squares are summed in the order of the elements."""
    square = np.zeros(len(data))
    for column in data.T:
        square += column.astype(np.float64) ** 2
    with np.errstate(invalid="ignore", divide="ignore"):
        return (data.astype(np.float64) / np.sqrt(square)[:, None]).astype(np.float32)


def _blocks(rows: DataFrame, key: str, size: int, block: int, name: str, unique: bool = False, parts: int = 0, scale: bool = False) -> DataFrame:
    """Rows of (name_keys, name_of, name_data): up to about ``block`` vectors each.

    Where ``parts`` is given, rows are first gathered into so many parts by their vectors, and a vector that several keys
    of a block share is held once; name_of then has the place of each key's vector, and is null otherwise. ``scale`` brings
    vectors to length one and leaves out those that have no direction.
    """
    kind = np.float64 if scale and dict(rows.dtypes)["vec"] != "array<float>" else np.float32
    given = F.col("vec").cast("array<double>" if kind is np.float64 else "array<float>").alias("vec")
    usable = rows.where(F.col(key).isNotNull() & F.col("vec").isNotNull() & (F.size("vec") == size)).select(F.col(key).cast("long").alias("key"), given)
    if not unique:
        usable = usable.dropDuplicates(["key"])
    if parts:
        usable = usable.repartition(parts, "vec")

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), block):
                part = batch.iloc[s : s + block]
                data, keys, of = np.array([np.asarray(v, kind) for v in part["vec"]], kind), part["key"].to_numpy(), None
                if scale:
                    data = _units(data)
                    there = np.isfinite(data).all(axis=1)
                    data, keys = data[there], keys[there]
                if parts:
                    data, of = np.unique(data, axis=0, return_inverse=True)
                    of = of.reshape(-1)
                yield pd.DataFrame({f"{name}_keys": [keys], f"{name}_of": [of], f"{name}_data": [data.tobytes()]})

    return usable.mapInPandas(gather, f"{name}_keys array<long>, {name}_of array<long>, {name}_data binary")


def _product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All inner products of the rows of ``a`` and ``b``, and by how much each row of ``a`` may be off. They are made in
    single precision, whose rounding is bounded by the lengths, and in double where these are out of its range."""
    long, wide = np.linalg.norm(a.astype(np.float64), axis=1), np.linalg.norm(b.astype(np.float64), axis=1).max(initial=0)
    if long.max(initial=0) < 1e18 and wide < 1e18:
        return a @ b.T, a.shape[1] * 2.0**-23 * long * wide
    return a.astype(np.float64) @ b.astype(np.float64).T, np.zeros(len(a))


def _exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """The inner products of the pairs (i, j) in double precision, to nine places."""
    of = lambda s: np.einsum("ij,ij->i", a[i[s : s + step]].astype(np.float64), b[j[s : s + step]].astype(np.float64))
    return np.round(np.concatenate([of(s) for s in range(0, len(i), step)] or [np.zeros(0)]), 9)


def search(queries: DataFrame, corpus: DataFrame, k: int = 30, size: int = 64, block: int = 1024, unique: bool = False, query_block: int = 4096, scale: bool = False) -> DataFrame:
    """(qid, idx, dense_score, rank): the k rows of greatest inner product with each query, ties by idx.

    ``queries``: qid, vec; ``corpus``: idx, vec. Vectors that are null or of another length are left out. ``unique`` says
    that no idx of the corpus repeats, so that its vectors are compared where they lie; ``scale``, that these are of any
    length and count at length one. Queries of the same vector are
    compared once in a block. Products in single precision, with their bound of error, tell which pairs can count; only
    these get their score, in double precision.
    """
    asked_count = queries.count()
    asked = _blocks(queries, "qid", size, query_block, "q", parts=max(1, -(-asked_count // query_block)))
    held = _blocks(corpus, "idx", size, block, "c", unique, scale=scale)
    if asked_count * (4 * size + 16) <= BROADCAST_BYTES:
        asked = F.broadcast(asked)

    def best_of(count: int, hits: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        """Each query's k-th best score (-inf where it has fewer), and its k best hits (query's place, idx, score)."""
        i, c, score = (np.concatenate(x) for x in zip(*hits, strict=True))
        order = np.lexsort((c, -score, i))
        i, c, score = i[order], c[order], score[order]
        start = np.searchsorted(i, np.arange(count + 1))
        place = np.arange(len(i)) - start[i]
        least = np.full(count, -np.inf)
        least[i[place == k - 1]] = score[place == k - 1]
        return least, i[place < k], c[place < k], score[place < k]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # by query block: its keys, their vectors' places, each vector's least score that can still count, its hits
        held: dict[int, list] = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                q, c = np.asarray(row.q_keys), np.asarray(row.c_keys)
                a = np.frombuffer(row.q_data, np.float32).reshape(-1, size)
                b = np.frombuffer(row.c_data, np.float32).reshape(len(c), size)
                mine = held.setdefault(int(q[0]), [q, np.asarray(row.q_of), np.full(len(a), -np.inf), []])
                score, off = _product(a, b)
                least = mine[2]
                if len(c) > k and np.isneginf(least).any():
                    least = np.maximum(least, np.partition(score, len(c) - k, axis=1)[:, len(c) - k] - off)
                # rounding moves a score by half of 0.000000001 at most
                floor = np.nextafter((least - off - 2e-9).astype(score.dtype), score.dtype.type(-np.inf))
                i, j = np.nonzero(score >= floor[:, None])
                mine[3].append((i, c[j], _exact(a, b, i, j)))
                if sum(len(h[0]) for h in mine[3]) > 2 * k * len(a):
                    mine[2], *rest = best_of(len(a), mine[3])
                    mine[3] = [tuple(rest)]
        for q, of, least, hits in held.values():
            _, i, c, score = best_of(len(least), hits)
            start = np.searchsorted(i, np.arange(len(least) + 1))
            n = start[of + 1] - start[of]
            at = np.repeat(start[of] - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield pd.DataFrame({"qid": np.repeat(q, n), "idx": c[at], "dense_score": score[at]})

    local = held.crossJoin(asked).mapInPandas(compare, "qid long, idx long, dense_score double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("dense_score"), "idx"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k)
