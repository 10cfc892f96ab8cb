import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexmill.llm import mixing, packing, subjects
from lexmill.llm.tokens import encoding, token_counts

CAPS = "container_kind string, capacity_tokens int"


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello, world"), (2, ""), (3, None), (None, "x"), (4, "Straße ☃ " * 3)], "doc_id long, text string").withColumn("tokens", F.lit("clash"))
    got = {r.doc_id: r.tokens for r in token_counts(df).collect()}
    assert got == {1: 3, 2: 0, 4: len(encoding("/opt/tokenizers/byte_bpe_50k.tiktoken").encode_ordinary("Straße ☃ " * 3))}


def naive_first_fit(sizes, capacity):
    room, out = [], {}
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = next((b for b, r in enumerate(room) if r >= sizes[k]), None)
        if at is None:
            room.append(capacity)
            at = len(room) - 1
        room[at] -= sizes[k]
        out[k] = at
    return out


def test_first_fit_decreasing_is_first_fit():
    import numpy as np

    rng = random.Random(2)
    for _ in range(20):
        sizes = [rng.randint(0, 100) for _ in range(rng.randint(0, 200))]
        got = packing.first_fit_decreasing(np.array(sizes, np.int64), 100)
        assert dict(enumerate(got.tolist())) == naive_first_fit(sizes, 100)


def test_packing_is_whole(spark):
    rng = random.Random(3)
    sizes = [(k, rng.choice([0, 5, 90, 300, 511, 512, 513, 5000])) for k in range(900)] + [(5, 1), (None, 4), (6, None)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long")
    kinds = spark.createDataFrame([("s", 512), ("l", 2048), ("none", 0), (None, 5), ("s", 512)], CAPS)
    rows = packing.pack(df, kinds, group_items=200).collect()
    true = {}
    for k, n in sizes:
        if k is not None and n is not None:
            true[k] = max(n, true.get(k, 0))
    for kind, cap in (("s", 512), ("l", 2048)):
        own = [r for r in rows if r.container_kind == kind]
        filled = {}
        for r in own:
            filled[r.container_id] = filled.get(r.container_id, 0) + r.tokens
        assert max(filled.values()) <= cap
        by = {}
        for r in own:
            by.setdefault(r.doc_id, []).append(r)
        for k, n in true.items():
            parts = sorted(by[k], key=lambda r: r.piece)
            assert sum(r.tokens for r in parts) == n and len(parts) == max(1, -(-n // cap)) == parts[0].pieces
            assert [r.token_from for r in parts] == [p * cap for p in range(len(parts))]
        assert len(filled) <= sum(true.values()) / cap * 1.06 + 5
    assert packing.pack(df.limit(0), kinds).count() == 0 and packing.pack(df, kinds.limit(0)).count() == 0


@pytest.mark.parametrize("least", [64, 512, 10**6])
def test_schedule_deviates_by_less_than_a_block(least):
    for blocks in ([4237, 3, 99, 1500, 777, 1200, 800, 9, 450, 2600], [1, 1], [5], [7, 7, 7, 100]):
        total = sum(blocks)
        span = mixing.frame_slots(blocks, least)
        rows = list(itertools.chain.from_iterable(mixing.schedule_frame(blocks, a, min(a + span, total)) for a in range(0, total, span)))
        assert [t for _, _, t in rows] == list(range(total))
        had = [0] * len(blocks)
        for s, k, t in rows:
            assert had[s] == k
            had[s] += 1
            assert all(abs(h * total - n * (t + 1)) < total for h, n in zip(had, blocks, strict=True))
        assert had == blocks


def test_mixture(spark):
    rng = random.Random(4)
    sizes = [(k, "abc"[k % 3] if k % 7 else "hot", rng.randint(0, 300)) for k in range(1500)] + [(9000, None, 5), (9001, "other", 5), (9002, "a", None), (0, "hot", 1)]
    df = spark.createDataFrame(sizes, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.3, 3), ("c", 0.1, None), ("hot", 0.4, 2), ("absent", 0.1, 9), (None, 0.5, 1), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    rows = mixing.mix(df, targets, block_tokens=256, frame=64, bucket_docs=50).collect()
    total = sum(r.tokens for r in rows)
    for source, share, most in (("a", 0.2, 1), ("b", 0.3, 3), ("c", 0.1, 1), ("hot", 0.4, 2)):
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.tokens for r in own) / total - share) < 0.01
        assert max(r.repeat for r in own) < most
        assert len({(r.doc_id, r.repeat) for r in own}) == len(own)
        starts = sorted((r.starts_at, r.tokens) for r in own)
        assert all(a + n <= b for (a, n), (b, _) in itertools.pairwise(starts))
        assert all(r.block == r.starts_at // 256 for r in own)
    assert {r.source for r in rows} == {"a", "b", "c", "hot"}
    assert len({(r.source, r.block) for r in rows}) == len({r.slot for r in rows})
    report = {r.source: r for r in mixing.share_report(spark.createDataFrame(rows), targets).collect()}
    assert report["absent"].tokens == 0 and abs(report["hot"].actual_share - 0.4) < 0.01
    assert mixing.mix(df.limit(0), targets).count() == 0


NAMES = [("farm", "Farming and fishing"), ("law", "Law and courts"), ("art", "Arts and culture")]
OWN = {"farm": "hives silos fodder graziers livestock paddock shearing tractors".split(), "law": "barristers summons robes motions courts notaries pleadings deeds".split(), "art": "sculptors canvas royalties kilns concerts novels galleries paint".split()}


def sentence(rng, kind):
    a, b = rng.sample(OWN[kind], 2)
    return rng.choice([f"Most {a} are claimed with {b} in the year.", f"The office treats {a} as part of {b}.", f"Where {a} share {b}, the charge is reduced.", f"What matters is {a}, not the price of {b}."])


def plain(rng):
    return f"You can lodge form BE-{rng.randint(1, 99)} online until {rng.randint(1, 28)} May."


def labelled(n=240, seed=5):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        kind = rng.choice(list(OWN))
        slug = dict(NAMES)[kind].lower().replace(" ", "-")
        text = " ".join(sentence(rng, kind) if rng.random() < 0.7 else plain(rng) for _ in range(8))
        url, crumb = (f"https://h.example/x/{slug}/p{k}", None) if k % 3 else (None, f"X > {dict(NAMES)[kind].title()} > P")
        rows.append((url, crumb, text))
    return rows


def test_subjects_of_held_out_documents(spark):
    chunks = spark.createDataFrame([*labelled(), ("https://h.example/nothing", None, "text"), (None, None, None)], "url string, breadcrumb string, text string").withColumn("subject", F.lit("clash"))
    names = spark.createDataFrame([*NAMES, NAMES[0], (None, "x"), ("y", None)], "subject string, subject_name string")
    rng = random.Random(8)
    docs, true = [], set()
    for k in range(150):
        kinds = rng.sample(list(OWN), rng.choice([1, 1, 2]))
        parts = [sentence(rng, kinds[j % len(kinds)]) for j in range(6)] + [plain(rng) for _ in range(3)]
        rng.shuffle(parts)
        docs.append((k, " ".join(parts)))
        true |= {(k, x) for x in kinds}
    docs += [(500, None), (501, ""), (None, "hives and silos")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("odds", F.lit("clash"))
    labels = spark.createDataFrame([(k, s, "desk") for k, s in true if k < 40] + [(3, None, None), (None, "law", None)], "doc_id long, subject string, labeller string")
    got = {(r.doc_id, r.subject) for r in subjects.subjects_of(table, chunks, names, labels, bits=14).collect()}
    hit = len(got & true)
    assert hit / len(true) > 0.95 and hit / len(got) > 0.95
    assert not {d for d, _ in got} & {500, 501}


def test_level_counts_every_labelled_document(spark, monkeypatch):
    """The level comes from all 5,000 labelled documents; the even ones have a second subject up to 60 only, which is
    first wrong and then right."""
    asked = []

    def scored(documents, models, bits):
        asked.append(documents.count())
        one = documents.select("doc_id", F.lit("a").alias("subject"), F.lit(95).alias("odds"), F.lit(95).alias("most"), F.lit(1).cast("long").alias("sentences"))
        return one.unionByName(one.where("doc_id % 2 = 0").withColumns({"subject": F.lit("b"), "odds": F.lit(60)}))

    monkeypatch.setattr(subjects, "_sentence_subjects", scored)
    docs = spark.range(6000).selectExpr("id AS doc_id", "'x' AS text")
    labels = spark.range(5000).selectExpr("id AS doc_id", "'a' AS subject")
    assert subjects.best_level(docs, labels.unionByName(labels.limit(9)), {"a": None}, 14, 0.25) == 75
    assert subjects.best_level(docs, labels.unionByName(labels.where("doc_id % 2 = 0").selectExpr("doc_id", "'b' AS subject")), {"a": None}, 14, 0.25) == 60
    assert asked == [5000, 5000]


def test_subjects_without_training(spark):
    chunks = spark.createDataFrame([], "url string, breadcrumb string, text string")
    docs = spark.createDataFrame([(1, "hives")], "doc_id long, text string")
    assert subjects.subjects_of(docs, chunks, spark.createDataFrame(NAMES, "subject string, subject_name string")).count() == 0


def test_sentences():
    assert subjects.sentences_of("One e.g. two. Three Co. four? five\nsix; Seven; eight") == ["One e.g. two.", "Three Co. four?", "five", "six;", "Seven; eight"]
    assert subjects.sentences_of(None) == [] == subjects.sentences_of(" \n ")


def test_long_texts_have_the_same_count_in_stretches():
    from lexmill.llm import tokens

    text = "It's  a\n\n fee, of 1,000  dollars\t(or so).\n" * 40 + "unbroken" * 50 + " end"
    whole = tokens.encoding(tokens.VOCABULARY).encode_ordinary(text)
    for length in (1, 7, 100, 5000):
        parts = list(tokens.stretches(text, length))
        assert "".join(parts) == text
        assert [t for p in parts for t in tokens.encoding(tokens.VOCABULARY).encode_ordinary(p)] == whole
