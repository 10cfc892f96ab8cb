"""Near-duplicate texts by a signature-coordinate inverted join.

1. A text is the set of its runs of ``shingle`` words. Its signature has ``coordinates`` values, each the hash of
   ``width`` independent min-hashes, so that a coordinate agrees with probability J ** width. Texts with the same
   words in the same order are one class from here on, so copies cost nothing.
2. Classes are posted under each coordinate-value pair. Lists of one entry are left out.
3. Lists are merged by a self-join on the pair, which adaptive execution splits where a list is long. Prefix: of
   the coordinates of a class, in order of list length, the last ``matches - 1`` need not be merged, since two
   classes with ``matches`` agreements also agree before them; this is used for lists above ``long_list``.
   Skip: agreements on long lists are not counted by merging but by intersecting the classes' few long keys.
4. Pairs with at least ``matches`` agreements are verified on their words, exactly.

With 32 coordinates of width 4 and two matches, a pair of similarity 0.7 is missed with probability 0.002, one
of 0.8 with 3e-6; unrelated texts hardly ever agree twice. No pairs are cut, capped or sampled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.session import materialize

_WORD = re.compile(r"[a-z0-9]+")
#: Bytes up to which the keys of the texts to verify are broadcast instead of shuffling all texts.
BROADCAST_BYTES = 32 << 20


def words_of(title: str | None, text: str | None) -> list[str]:
    """Runs of a-z and 0-9 of title, a space and text, after lower-casing; a null counts as empty."""
    return _WORD.findall(f"{title or ''} {text or ''}".lower())


def shingles_of(words: list[str], size: int) -> set[tuple[str, ...]]:
    return set(zip(*(words[k:] for k in range(size)), strict=False))


def _signer(shingle: int, coordinates: int, width: int):
    """A function from word hashes to the signature: a 32-bit value for each coordinate."""
    rng = np.random.default_rng(20240229)
    odd = lambda n, kind: rng.integers(1, np.iinfo(kind).max, n, dtype=kind) | kind(1)
    place = odd(shingle, np.uint64)
    times, plus = odd(coordinates * width, np.uint32), odd(coordinates * width, np.uint32)
    fold, turn = odd(width, np.uint64), odd(coordinates, np.uint64)

    def sign(hashes: np.ndarray) -> np.ndarray:
        n = len(hashes) - shingle + 1
        runs = hashes[:n] * place[0]
        for k in range(1, shingle):
            runs = (runs ^ (runs >> np.uint64(29))) + hashes[k : k + n] * place[k]
        runs ^= runs >> np.uint64(32)
        runs *= np.uint64(0x9E3779B97F4A7C15)
        low = (runs >> np.uint64(32)).astype(np.uint32)
        least = np.full(coordinates * width, np.iinfo(np.uint32).max, np.uint32)
        for k in range(0, n, 1024):
            part = (low[k : k + 1024, None] ^ plus) * times
            least = np.minimum(least, part.min(axis=0))
        keys = (least.reshape(coordinates, width).astype(np.uint64) + np.uint64(1)) * fold
        keys = (keys ^ (keys >> np.uint64(31))).sum(axis=1, dtype=np.uint64) * turn
        return (keys >> np.uint64(32)).astype(np.uint32).view(np.int32)

    return sign


def signatures(
    docs: DataFrame, id_col: str = "id", title_col: str | None = "title", text_col: str = "text", shingle: int = 5, min_words: int = 1, coordinates: int = 32, width: int = 4
) -> DataFrame:
    """(id, node, keys): node is the hash of the word sequence, keys the hashed value of each coordinate.

    Left out: null ids and texts, texts of fewer than ``min_words`` words, and those too short for one shingle.
    Texts of any length are read whole.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sign = _signer(shingle, coordinates, width)
        for batch in batches:
            known: dict[str, int] = {}
            ids, nodes, keys = [], [], []
            for key, title, text in zip(batch["id"], batch["title"], batch["text"], strict=True):
                head, body = words_of(title, ""), words_of("", text)
                if len(body) < min_words or len(head) + len(body) < shingle:
                    continue
                words = head + body
                for w in words:
                    if w not in known:
                        known[w] = xxhash.xxh3_64_intdigest(w)
                hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                ids.append(key)
                nodes.append(xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63))
                keys.append(sign(hashes))
            yield pd.DataFrame({"id": ids, "node": pd.Series(nodes, dtype="int64"), "keys": keys})

    title = F.col(title_col) if title_col else F.lit("")
    return (
        docs.select(F.col(id_col).cast("string").alias("id"), title.alias("title"), F.col(text_col).alias("text"))
        .where(F.col("id").isNotNull() & F.col("text").isNotNull())
        .mapInPandas(scan, "id string, node long, keys array<int>")
    )


def colliding_pairs(nodes: DataFrame, matches: int = 2, long_list: int = 1000) -> DataFrame:
    """(a, b), a < b: the nodes that agree on at least ``matches`` coordinate-value pairs. ``nodes``: node, keys."""
    key = F.col("at").cast("long") * (1 << 32) + F.col("value")
    posts = nodes.select(F.posexplode("keys").alias("at", "value"), "node").select(key.alias("key"), "node").repartition("key")
    lists = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = posts.join(lists, "key").select("key", "node", "n")
    long_keys = (
        shared.where(F.col("n") > long_list)
        .groupBy("node")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "key"))), lambda x: x["key"]).alias("long"))
    )
    no_keys = F.array().cast("array<bigint>")
    posted = shared.join(long_keys, "node", "left").withColumn("long", F.coalesce("long", no_keys))
    dropped = F.slice(F.reverse("long"), 1, matches - 1) if matches > 1 else no_keys
    merged = posted.where((F.col("n") <= long_list) | ~F.array_contains(dropped, F.col("key")))
    a = merged.select("key", "n", F.col("node").alias("a"), F.col("long").alias("long_a"))
    b = merged.select("key", F.col("node").alias("b"), F.col("long").alias("long_b"))
    counted = F.sum(F.when(F.col("n") <= long_list, 1).otherwise(0)) + F.first(F.size(F.array_intersect("long_a", "long_b")))
    return a.join(b, "key").where("a < b").groupBy("a", "b").agg(counted.alias("agree")).where(F.col("agree") >= matches).select("a", "b")


def _similarity(shingle: int) -> Column:
    @F.pandas_udf("double")
    def jaccard(title_a: pd.Series, text_a: pd.Series, title_b: pd.Series, text_b: pd.Series) -> pd.Series:
        out = []
        for ta, xa, tb, xb in zip(title_a, text_a, title_b, text_b, strict=True):
            a, b = shingles_of(words_of(ta, xa), shingle), shingles_of(words_of(tb, xb), shingle)
            both = len(a & b)
            out.append(both / (len(a) + len(b) - both) if both else 0.0)
        return pd.Series(out, dtype="float64")

    return jaccard("title_a", "text_a", "title_b", "text_b")


def similar_classes(
    docs: DataFrame,
    threshold: float = 0.8,
    shingle: int = 5,
    min_words: int = 1,
    id_col: str = "id",
    title_col: str | None = "title",
    text_col: str = "text",
    coordinates: int = 32,
    width: int = 4,
    matches: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """Membership (id, node) and the links (a, b, similarity) between the classes of equal texts.

    A link stands between two classes whose shingle sets have at least the threshold's Jaccard similarity.
    """
    signed = materialize(signatures(docs, id_col, title_col, text_col, shingle, min_words, coordinates, width))
    members = signed.select("id", "node").distinct()
    nodes = signed.groupBy("node").agg(F.min("id").alias("rep"), F.first("keys").alias("keys"))
    pairs = colliding_pairs(nodes.select("node", "keys"), matches)
    reps = signed.groupBy("node").agg(F.min("id").alias("rep"))
    named = pairs.join(reps.select(F.col("node").alias("a"), F.col("rep").alias("rep_a")), "a").join(reps.select(F.col("node").alias("b"), F.col("rep").alias("rep_b")), "b")
    named = materialize(named)
    wanted = named.select(F.col("rep_a").alias("id")).union(named.select("rep_b")).distinct()
    if named.count() * 2 * 64 <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    title = F.col(title_col) if title_col else F.lit("")
    texts = (
        docs.select(F.col(id_col).cast("string").alias("id"), title.alias("title"), F.col(text_col).alias("text"))
        .where(F.col("id").isNotNull() & F.col("text").isNotNull())
        .join(wanted, "id", "left_semi")
        .dropDuplicates(["id"])
    )
    side = lambda x: texts.select(*(F.col(c).alias(f"{c}_{x}") for c in ("id", "title", "text"))).withColumnRenamed(f"id_{x}", f"rep_{x}")
    verified = named.join(side("a"), "rep_a").join(side("b"), "rep_b").select("a", "b", _similarity(shingle).alias("similarity"))
    return members, verified.where(F.col("similarity") >= threshold)


def similar_pairs(docs: DataFrame, **how) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: every pair of different ids whose similarity reaches the threshold.

    Pairs between classes are expanded to their members, members of one class to pairs of similarity 1. A
    table with repeated rows counts each id once; empty tables and texts give no pairs.
    """
    members, links = similar_classes(docs, **how)
    links = materialize(links)
    ma, mb = members.select(F.col("id").alias("x"), F.col("node").alias("a")), members.select(F.col("id").alias("y"), F.col("node").alias("b"))
    between = links.join(ma, "a").join(mb, "b").where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")
    copied = members.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("node").alias("a"))
    copies = ma.join(copied, "a", "left_semi")
    within = copies.join(copies.withColumnRenamed("x", "y"), "a").where("x < y").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"), F.lit(1.0).alias("similarity"))
    return between.unionByName(within).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component of ``edges`` (a, b), by large and small stars.

    Each round joins and aggregates edges by node with partial aggregation, and cuts its lineage; rounds follow until
    one changes no edge, and their number grows with the logarithm of the longest chain. Nodes without edges are not given.
    """
    now = materialize(edges.select("a", "b").where("a != b").distinct())
    mark = F.sum(F.xxhash64(F.greatest("a", "b"), F.least("a", "b")).cast("decimal(38,0)"))
    state = now.agg(F.count(F.lit(1)), mark).first()
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = large.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        root = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(root, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(root.select("u", "m")).where("a != b").distinct()
        now = materialize(small)
        then, state = state, now.agg(F.count(F.lit(1)), mark).first()
        if then == state:
            break
    stars = now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("label"))
    return stars.union(stars.select("label", "label")).distinct()


def near_duplicate_groups(docs: DataFrame, **how) -> DataFrame:
    """(id, class_id, group_id, links): one row per id, with its class of equal texts, its group of texts that
    are linked directly or through others, and its class's number of links to other classes. Classes and groups are
    named by their least ids. Ids whose text is null or too short to compare have neither class nor group, and no links."""
    every = docs.select(F.col(how.get("id_col", "id")).cast("string").alias("id")).where("id IS NOT NULL").distinct()
    members, links = similar_classes(docs, **how)
    links = materialize(links)
    degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("links"))
    classes = members.groupBy("node").agg(F.min("id").alias("class_id")).join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = materialize(classes.join(degree, "node", "left"))
    groups = classes.groupBy("label").agg(F.min("class_id").alias("group_id"))
    named = members.join(classes.join(groups, "label").select("node", "class_id", "group_id", "links"), "node")
    return every.join(named.drop("node"), "id", "left").select("id", "class_id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))
