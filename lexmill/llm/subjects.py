"""Subject areas of documents: one-versus-rest linear classifiers on hashed word n-grams.

Weak labels: a page's address path (or its breadcrumb) names a subject; each sentence of its chunks gets it.
Sentences are drawn by hash into a training sample of bounded size, evenly over subjects and languages. For
each subject a logistic classifier is fitted on the hashed words and word pairs of these sentences. A document
deals with a subject if the subject's sentences are at least a quarter of those that bear any. How sure a
classifier must be for a sentence to bear its subject is calibrated on weakly labelled sentences kept out of
training, so that sentences which all subjects share bear none.

Counting, drawing, scoring and aggregation are Spark jobs over whole tables and whole texts. What is fitted in
one task is bounded: ``per_stratum`` sentences for each subject and language at most (14 x 4 x 2,000 = 112,000
here), which grows with the number of subjects, and each sentence goes to the task of each subject. Sentences of under
20 or over 2,000 characters train nothing; they are scored like all others. The models, 2 ** bits weights for each
subject, are what is broadcast; the subjects are configuration and come whole to the driver.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import materialize

#: By subject: weights, bias, slope and offset of the likelihood curve.
Models = dict[str, tuple[np.ndarray, float, float, float]]

#: A feature gets a weight if it stands in at least so many different training sentences.
LEAST_SENTENCES = 4

_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+")
_BREAK = re.compile(r"(?<=[.!?])[ \t]+|(?<=;)[ \t]+(?=[^\W\d_a-zß-ÿ])")
_SHORT = re.compile(r"(?:^|[\s(])(?:e\.g|i\.e|etc|approx|s|no|inc|co|ltd|dr|mr|mrs|st|z\.b|ca|bzw|nr|art)\.$", re.IGNORECASE)
#: Frequent short words by which the language of a sentence is guessed.
LANGUAGE_WORDS = {
    "fr": "le la les des du une pour dans sur est sont que qui aux par avec",
    "de": "der die das und für ist sind mit von den dem ein eine bis wird werden zu",
    "es": "el los las del una para por con que son está hasta como sin",
}


def sentences_of(text: str | None) -> list[str]:
    """Sentences of a text: parts between line breaks and end marks, shortened words apart."""
    if not text:
        return []
    out: list[str] = []
    for line in html.unescape(text).split("\n"):
        parts = _BREAK.split(line.strip())
        held = ""
        for part in parts:
            held = f"{held} {part}" if held else part
            if not _SHORT.search(held):
                out.append(held)
                held = ""
        if held:
            out.append(held)
    return [s for s in out if s.strip()]


class Hasher:
    """Hashed features of sentences: words (numbers as one) and pairs of neighbouring words."""

    def __init__(self, bits: int) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.known: dict[str, int] = {}

    def words(self, sentence: str) -> np.ndarray:
        found = []
        for w in _TOKEN.findall(sentence.lower()):
            h = self.known.get(w)
            if h is None:
                if len(self.known) > 500_000:
                    self.known.clear()
                h = self.known[w] = xxhash.xxh3_64_intdigest("0" if w[0].isdigit() else w)
            found.append(h)
        return np.array(found, np.uint64)

    def features(self, sentence: str) -> np.ndarray:
        w = self.words(sentence)
        pairs = (w[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (w[1:] >> np.uint64(7))
        pairs ^= pairs >> np.uint64(32)
        return (np.concatenate([w ^ (w >> np.uint64(29)), pairs * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(9)]) & self.mask).astype(np.int64)


def language_of(sentence: str) -> str:
    words = set(_TOKEN.findall(sentence.lower()))
    score = {k: len(words & set(v.split())) for k, v in LANGUAGE_WORDS.items()}
    best = max(score, key=score.get)
    return best if score[best] >= 2 else "en"


def subject_slug(name: Column) -> Column:
    """A subject's name as it stands in address paths."""
    return F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-")


def weak_labels(chunks: DataFrame, subjects: DataFrame) -> DataFrame:
    """(text, subject): chunks whose address path, or else breadcrumb, has a subject's name as a segment."""
    names = F.broadcast(subjects.where(F.col("subject").isNotNull() & F.col("subject_name").isNotNull()).select("subject", subject_slug(F.col("subject_name")).alias("slug")).distinct())
    segment = lambda c: F.filter(c, lambda x: x != "")
    path = segment(F.split(F.regexp_replace(F.lower("url"), r"^[a-z]+://[^/]*", ""), "/"))
    crumbs = F.transform(F.split(F.lower("breadcrumb"), r"\s*>\s*"), lambda x: F.regexp_replace(F.trim(x), "[^a-z0-9]+", "-"))
    rows = chunks.where(F.col("text").isNotNull()).select("text", F.concat(F.coalesce(path, F.array()), F.coalesce(crumbs, F.array())).alias("at"))
    return rows.select("text", F.explode(F.array_distinct("at")).alias("slug")).join(names, "slug").select("text", "subject")


def _labelled_sentences(labelled: DataFrame, subjects_seed: int) -> DataFrame:
    """(subject, lang, draw, sentence) of weakly labelled texts; draw is a hash that orders the drawing."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, subject in zip(batch["text"], batch["subject"], strict=True):
                for s in sentences_of(text):
                    if 20 <= len(s) <= 2000:
                        draw = xxhash.xxh3_64_intdigest(s, seed=subjects_seed) >> 33
                        rows.append((subject, language_of(s), draw, s))
            yield pd.DataFrame(rows, columns=["subject", "lang", "draw", "sentence"])

    return labelled.mapInPandas(scan, "subject string, lang string, draw long, sentence string")


def training_sample(chunks: DataFrame, subjects: DataFrame, per_stratum: int = 2000, pool_texts: int = 6000, seed: int = 11) -> DataFrame:
    """(subject, draw, sentence): weakly labelled sentences, at most about ``per_stratum`` for each subject and
    language. Texts are first thinned by hash to about ``pool_texts`` for each subject at most."""
    labelled = weak_labels(chunks, subjects)
    sizes = labelled.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    thin = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 20)) < F.least(F.lit(1.0), F.lit(float(pool_texts)) / F.col("n")) * (1 << 20)
    pool = labelled.join(F.broadcast(sizes), "subject").where(thin).select("text", "subject")
    # counted by stratum and then drawn from, so it is written once
    drawn = materialize(_labelled_sentences(pool, seed))
    strata = drawn.groupBy("subject", "lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(per_stratum)) / F.col("n"))
    return drawn.join(F.broadcast(strata), ["subject", "lang"]).where(F.col("draw") < share * (1 << 31)).select("subject", "draw", "sentence")


def _margins(parts: list[np.ndarray], table: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Margins of each classifier for each sentence's features; none may be empty."""
    size = np.array([len(f) for f in parts])
    return np.add.reduceat(table[np.concatenate(parts)], np.r_[0, np.cumsum(size)[:-1]], axis=0) / np.sqrt(size)[:, None] + base


def hashed_sample(sample: DataFrame, bits: int, held_out: float) -> DataFrame:
    """(label, draw, kept_out, features) of a sample's sentences."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(bits)
        for batch in batches:
            features = [np.unique(hasher.features(s)).astype(np.int32) for s in batch["sentence"]]
            out = [xxhash.xxh3_64_intdigest(s, seed=5) % 1000 < held_out * 1000 for s in batch["sentence"]]
            rows = pd.DataFrame({"label": batch["subject"].to_numpy(), "draw": batch["draw"].to_numpy(), "kept_out": out, "features": features})
            yield rows[[len(f) > 0 for f in features]]

    return sample.mapInPandas(scan, "label string, draw long, kept_out boolean, features array<int>")


def _trained(rows: pd.DataFrame, subject: str, dims: int, rounds: int, shrink: float) -> tuple[np.ndarray, float]:
    """Weights and bias of one subject's logistic classifier, both classes weighing the same."""
    feats = [np.asarray(f) for f in rows["features"]]
    yes = (rows["label"] == subject).to_numpy()
    # a sentence that is always the same tells nothing of its words: they must stand in several different ones
    distinct = list({f.tobytes(): f for f in feats}.values())
    spread = np.bincount(np.concatenate(distinct), minlength=dims) >= LEAST_SENTENCES if distinct else np.zeros(dims, bool)
    feats = [f[spread[f]] for f in feats]
    size = np.array([len(f) for f in feats])
    at = np.repeat(np.arange(len(feats)), size)
    cols, names = np.unique(np.concatenate(feats), return_inverse=True)[::-1] if feats else (np.zeros(0, int), np.zeros(0, int))
    value = (1 / np.sqrt(np.maximum(size, 1)))[at]
    weight = np.where(yes, 0.5 / max(1, yes.sum()), 0.5 / max(1, (~yes).sum())) * len(feats)
    w, bias, past, past_bias = np.zeros(len(names)), 0.0, np.full(len(names), 1e-6), 1e-6
    margin = np.zeros(len(feats))
    for _ in range(rounds):
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - yes)
        grad = np.bincount(cols, value * error[at], len(names)) + shrink * w
        past += grad**2
        past_bias += error.sum() ** 2
        w -= grad / np.sqrt(past)
        bias -= error.sum() / np.sqrt(past_bias)
        margin = np.bincount(at, value * w[cols], len(feats)) + bias
    full = np.zeros(dims, np.float32)
    full[names] = w
    return full, float(bias)


def calibrated(hashed: DataFrame, models: dict[str, tuple[np.ndarray, float]]) -> Models:
    """Adds the logistic curve by which a sentence's margin, for the subject it scores highest for, tells how likely
    its weak label is right; fitted on the sentences held out, with one slope and an offset for each subject."""
    names = sorted(models)
    if not names:
        return {}
    table, base = np.stack([models[n][0] for n in names], axis=1), np.array([models[n][1] for n in names])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                score = _margins(list(batch["features"]), table, base)
                top = score.argmax(axis=1)
                right = [y == names[t] for y, t in zip(batch["label"], top, strict=True)]
                yield pd.DataFrame({"top": top, "right": right, "margin": score.max(axis=1)})

    seen = hashed.where("kept_out").select("label", "features").mapInPandas(scan, "top int, right boolean, margin double").toPandas()
    top, right, margin = seen["top"].to_numpy(), seen["right"].to_numpy(float), seen["margin"].to_numpy()
    slope, offset = 1.0, np.zeros(len(names))
    size = np.maximum(np.bincount(top, minlength=len(names)), 1) if len(top) else np.ones(len(names))
    for _ in range(300 if len(top) else 0):
        error = 1 / (1 + np.exp(-(slope * margin + offset[top]))) - right
        slope = max(slope - 0.5 * (error * margin).mean(), 0.05)
        # offsets of subjects with few held-out sentences stay near the others'
        offset -= 0.5 * (np.bincount(top, error, len(names)) + 2 * (offset - offset.mean())) / (size + 2)
    return {n: (*models[n], slope, float(offset[k])) for k, n in enumerate(names)}


def fit(sample: DataFrame, names: list[str], bits: int = 16, rounds: int = 80, shrink: float = 0.4, held_out: float = 0.2) -> Models:
    """By subject: (weights, bias, slope, offset). One task fits one subject on the bounded sample, without the
    sentences that are held out for the thresholds."""
    hashed = materialize(hashed_sample(sample, bits, held_out))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        w, bias = _trained(rows.sort_values(["draw", "label"], kind="stable"), key[0], 1 << bits, rounds, shrink)
        return pd.DataFrame({"subject": [key[0]], "w": [w.tobytes()], "bias": [bias]})

    subjects = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    each = hashed.where("NOT kept_out").select(F.explode(subjects).alias("subject"), "label", "draw", "features")
    fitted = each.groupBy("subject").applyInPandas(one, "subject string, w binary, bias double").collect()
    return calibrated(hashed, {r.subject: (np.frombuffer(r.w, np.float32), r.bias) for r in fitted})


def _sentence_subjects(documents: DataFrame, models: Models, bits: int) -> DataFrame:
    """(doc_id, subject, odds, most, sentences): by document, best subject and likelihood in hundredths, the number of
    its sentences; ``most`` is the document's highest likelihood."""
    names = sorted(models)
    held = documents.sparkSession.sparkContext.broadcast((np.stack([models[n][0] for n in names], axis=1), *(np.array([models[n][k] for n in names]) for k in (1, 2, 3))))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(bits)
        table, base, slope, offset = held.value
        for batch in batches:
            docs, parts, out = [], [], []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                for s in sentences_of(text):
                    f = np.unique(hasher.features(s))
                    if len(f):
                        docs.append(doc)
                        parts.append(f)
            for k in range(0, len(parts), 20_000):
                score = _margins(parts[k : k + 20_000], table, base)
                top = score.argmax(axis=1)
                odds = 100 / (1 + np.exp(-(slope[top] * score.max(axis=1) + offset[top])))
                out.append(pd.DataFrame({"doc_id": docs[k : k + 20_000], "subject": np.array(names, object)[top], "odds": odds.astype(np.int32)}))
            if out:
                rows = pd.concat(out)
                rows["most"] = rows.groupby("doc_id")["odds"].transform("max")
                yield rows.groupby(["doc_id", "subject", "odds", "most"]).size().rename("sentences").reset_index()

    return (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
        .mapInPandas(scan, "doc_id long, subject string, odds int, most int, sentences long")
    )


def _bears(level: int | Column) -> Column:
    return (F.col("odds") >= level) | ((F.col("most") < level) & (F.col("odds") >= 40))


def _shares(bearing: DataFrame, least_share: float) -> DataFrame:
    counted = bearing.groupBy("doc_id", "subject").agg(F.sum("sentences").alias("sentences"))
    by_doc = counted.groupBy("doc_id").agg(F.sum("sentences").alias("all"), F.collect_list(F.struct("subject", "sentences")).alias("each"))
    share = F.col("one.sentences") / F.col("all")
    rows = by_doc.select("doc_id", F.explode("each").alias("one"), "all")
    return rows.select("doc_id", F.col("one.subject").alias("subject"), F.col("one.sentences").alias("sentences"), share.alias("share")).where(F.col("share") >= least_share)


def best_level(documents: DataFrame, hand_labels: DataFrame, models: Models, bits: int, least_share: float) -> int:
    """The likelihood, in hundredths, from which a sentence bears its subject, that gives the best F1 on all hand-labelled
    documents; without any it is 75. Only the counts of each level come to the driver."""
    true = hand_labels.where("doc_id IS NOT NULL AND subject IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "subject").distinct()
    labels = true.count()
    if not labels:
        return 75
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(true.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    levels = range(40, 96, 5)
    seen = _sentence_subjects(texts, models, bits).select(F.explode(F.array(*map(F.lit, levels))).alias("level"), "*")
    counted = seen.where(_bears(F.col("level"))).groupBy("level", "doc_id", "subject").agg(F.sum("sentences").alias("sentences"))
    share = F.col("sentences") / F.sum("sentences").over(Window.partitionBy("level", "doc_id"))
    kept = counted.withColumn("share", share).where(F.col("share") >= least_share).join(true.withColumn("true", F.lit(1)), ["doc_id", "subject"], "left")
    found = kept.groupBy("level").agg(F.count(F.lit(1)).alias("kept"), F.count("true").alias("right")).collect()
    score = dict.fromkeys(levels, 0.0) | {r.level: 2 * r.right / (r.kept + labels) for r in found}
    return max(score, key=lambda x: (score[x], -abs(x - 75)))


def assign(documents: DataFrame, models: Models, level: int = 75, bits: int = 16, least_share: float = 0.25) -> DataFrame:
    """(doc_id, subject, sentences, share): each subject with at least ``least_share`` of the document's
    subject-bearing sentences. Where no sentence reaches the level, those of at least even odds less a tenth count.
    Null and empty texts have no subject; repeated rows change no share."""
    if not models:
        return documents.sparkSession.createDataFrame([], "doc_id long, subject string, sentences long, share double")
    return _shares(_sentence_subjects(documents, models, bits).where(_bears(level)), least_share)


def subjects_of(documents: DataFrame, chunks: DataFrame, subjects: DataFrame, hand_labels: DataFrame | None = None, bits: int = 16, per_stratum: int = 2000, least_share: float = 0.25) -> DataFrame:
    """Fits on weakly labelled chunks, calibrates on hand labels if there are any, assigns every document."""
    names = [r.subject for r in subjects.select("subject").where("subject is not null").distinct().orderBy("subject").collect()]
    models = fit(training_sample(chunks, subjects, per_stratum), names, bits)
    level = best_level(documents, hand_labels, models, bits, least_share) if models and hand_labels is not None else 75
    return assign(documents, models, level, bits, least_share)
