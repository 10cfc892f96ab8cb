import random

import numpy as np
from pyspark.sql import functions as F

from lexmill.llm import near_duplicates as N
from lexmill.llm import vector_neighbors as V


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.6:
            text = rng.choice(rows)[2].split()
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(text))
                text[at : at + rng.randint(0, 2)] = [rng.choice(words) for _ in range(rng.randint(0, 2))]
        else:
            text = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        rows.append((f"d{k:04d}", rng.choice(["One title", "Another title", None]), " ".join(text)))
    return rows


def brute(rows, size, threshold, least):
    sets = {}
    for i, ti, tx in rows:
        if i is not None and tx is not None and len(N.words_of(None, tx)) >= least:
            s = N.shingles_of(N.words_of(ti, tx), size)
            if s:
                sets[i] = s
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


KIND = "id string, title string, text string"


def test_pairs_match_brute_force(spark):
    rows = corpus()
    rows += [("copy1", *rows[5][1:]), ("copy2", *rows[5][1:]), rows[5], ("null", None, None), (None, "t", rows[6][2]), ("short", "t", "a b"), ("blank", "", " "), ("caps", rows[7][1], rows[7][2].upper() + "!!")]
    df = spark.createDataFrame(rows, KIND).withColumn("node", F.lit("clash")).withColumn("keys", F.lit(1)).withColumn("a", F.lit(2))
    for size, threshold, least in ((3, 0.7, 30), (5, 0.8, 1)):
        got = {(r.id_a, r.id_b) for r in N.similar_pairs(df, threshold=threshold, shingle=size, min_words=least).collect()}
        want = brute(rows, size, threshold, least)
        assert len(want) > 50 and got == want


def test_hot_lists_lose_nothing(spark):
    """A third of the texts share one template, so that lists are long, and prefix and skip are at work."""
    rng = random.Random(9)
    stem = [f"s{k}" for k in range(60)]
    rows = corpus(2, 60)
    for k in range(40):
        text = list(stem)
        for _ in range(rng.randint(0, 12)):
            text[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((f"h{k:03d}", "", " ".join(text)))
    signed = N.signatures(spark.createDataFrame(rows, KIND), shingle=3)
    nodes = signed.groupBy("node").agg(F.first("keys").alias("keys"))
    whole = {(r.a, r.b) for r in N.colliding_pairs(nodes, 2, 10**9).collect()}
    for long_list in (1, 3, 8):
        assert {(r.a, r.b) for r in N.colliding_pairs(nodes, 2, long_list).collect()} == whole
    three = {(r.a, r.b) for r in N.colliding_pairs(nodes, 3, 10**9).collect()}
    assert {(r.a, r.b) for r in N.colliding_pairs(nodes, 3, 2).collect()} == three <= whole


def test_groups(spark):
    rows = corpus(4, 120)
    rows += [("copy", *rows[0][1:]), ("none", "t", None), ("short", None, "a b c")]
    got = {r.id: r for r in N.near_duplicate_groups(spark.createDataFrame(rows, KIND), threshold=0.7, shingle=3, min_words=30).collect()}
    assert len(got) == len({i for i, _, _ in rows})
    assert got["none"].group_id is None and got["short"].class_id is None and got["short"].links == 0
    got = {i: r for i, r in got.items() if r.class_id is not None}
    up = {i: i for i in got}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in brute(rows, 3, 0.7, 30):
        up[root(a)] = root(b)
    mine = {}
    for i, r in got.items():
        mine.setdefault(r.group_id, set()).add(i)
    true = {}
    for i in got:
        true.setdefault(root(i), set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, true.values()))
    assert got["copy"].class_id == got[rows[0][0]].class_id


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in N.components(edges).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, 100: 100, 101: 100}


def test_no_texts(spark):
    assert N.similar_pairs(spark.createDataFrame([], KIND)).count() == 0
    assert N.near_duplicate_groups(spark.createDataFrame([("a", None, None)], KIND)).count() == 1


def vectors(seed=1, n=600, size=64):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 6, size))
    rows = [(k, (centre[k % len(centre)] + 0.25 * rng.normal(size=size)).astype(np.float32).tolist()) for k in range(n)]
    return rows


def exact(rows, k, size=64):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in dict(rows).items() if v is not None and len(v) == size and any(v) and None not in v]
    ids = np.array([i for i, _ in good])
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    like = np.round(unit @ unit.T, 9)
    np.fill_diagonal(like, -2)
    order = np.lexsort((np.broadcast_to(ids, like.shape), -like), axis=1)[:, :k]
    return {(int(ids[r]), int(ids[c])): like[r, c] for r in range(len(ids)) for c in order[r]}


def test_close_pairs(spark):
    rows = vectors()
    rows += [(1000, None), (1001, [0.0] * 64), (1002, [1.0] * 10), (1003, rows[3][1]), (1004, [x * 7 for x in rows[3][1]]), (1005, [*rows[4][1][:63], None]), rows[2]]
    df = spark.createDataFrame(rows, "idx long, vec array<float>").withColumn("key", F.lit(1)).withColumn("a", F.lit(1))
    want = {(min(p), max(p)) for p, c in exact(rows, 10).items() if c >= 0.9}
    got = {(r.idx_a, r.idx_b) for r in V.close_pairs(df).collect()}
    assert len(want) > 300 and len(got & want) >= 0.995 * len(want) and len(got - want) <= 0.005 * len(want)
    assert {(3, 1003), (3, 1004), (1003, 1004)} <= got


def test_the_depth_for_many_vectors_finds_as_many(spark):
    assert V.close_parameters(10_000) == {"depth": 2, "tables": 8, "probes": 3}
    deep = V.close_parameters(10**8)
    assert deep["depth"] == 3
    rows = vectors(5)
    want = {(min(p), max(p)) for p, c in exact(rows, 10).items() if c >= 0.9}
    got = {(r.idx_a, r.idx_b) for r in V.close_pairs(spark.createDataFrame(rows, "idx long, vec array<float>"), **deep).collect()}
    assert len(want) > 300 and len(got & want) >= 0.995 * len(want)


def test_recall_of_all_neighbours(spark):
    rows = vectors(2, 800)
    df = spark.createDataFrame(rows, "idx long, vec array<float>")
    want = exact(rows, 10)
    asked = {(a, b) for a, b in want if a % 50 == 0}
    got = {(r.a, r.b) for r in V.nearest(df, is_query=F.col("idx") % 50 == 0, tables=8, depth=1, probes=8).collect()}
    assert all(a % 50 == 0 for a, _ in got)
    assert len(got & asked) >= 0.9 * len(asked)


def test_recall_of_the_defaults_without_a_floor(spark):
    rows = vectors(6, 1200)
    df = spark.createDataFrame(rows, "idx long, vec array<float>")
    want = set(exact(rows, 10))
    got = {(r.a, r.b) for r in V.nearest(df).collect()}
    assert len(got & want) >= 0.9 * len(want)
    asked = {(a, b) for a, b in want if a % 50 == 0}
    some = {(r.a, r.b) for r in V.nearest(df, is_query=F.col("idx") % 50 == 0).collect()}
    assert len(some & asked) >= 0.9 * len(asked)


def test_striped_buckets_give_the_same(spark):
    """A third of the vectors are alike, so one bucket is far above its size and cut into stripes."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=64)
    rows = [(k, (base + 0.05 * rng.normal(size=64)).astype(np.float32).tolist()) for k in range(100)] + [(200 + k, v) for k, v in vectors(4, 200)]
    df = spark.createDataFrame(rows, "idx long, vec array<float>")
    whole = {(r.a, r.b, r.rank) for r in V.nearest(df, min_cosine=0.5).collect()}
    cut = {(r.a, r.b, r.rank) for r in V.nearest(df, min_cosine=0.5, block_rows=16).collect()}
    assert whole == cut
    want = exact(rows[:100], 10)
    assert {(a, b) for a, b, _ in whole if a < 100 and b < 100} == set(want)


def test_pseudo_rotation_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(V._hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert V.CrossPolytope(48, 2, 2, 1).buckets(x[:, :48], 4).shape == (5, 2, 4)
