"""Toxicity classifier with counterfactual regularisation.

A text is the set of its distinct words, hashed into ``BUCKETS``; its score is logistic in the sum of their
weights.  Words are screened by grouped counts over all labelled training documents; weights are
fitted with an L1 penalty on a bounded sample of them (``SAMPLE`` rows in the order of a hash).

In the sampled sentences each identity term is swapped for the other terms of its group and for a
neutral word, and the squared change of the sentence's score is added to the loss.  A term that
merely keeps bad company thus cannot carry a weight of its own, and neutral mentions of a group do not
raise a score.  A corpus may mention few groups or none, so every sampled document also counts, with a small
weight and its own label, as a copy with one term inserted into a sentence; that sentence is swapped like any other, so
every term of ``IDENTITY`` is held to neutrality whether the corpus knows it or not.  Terms are always
screened and pay no L1 penalty: the swaps alone hold them.

Nulls and repeated rows: a null or wordless text gets the score of the intercept; a null id is
unlabelled and not held out; documents without a label or with other labels than 0 and 1 teach nothing;
an id with several labels teaches each.  Without both classes in training all scores are the smoothed
share of toxic labels.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotvalue.llm import tokens
from slotvalue.llm.arrow import batch_of, map_batches

BUCKETS = 1 << 18
# Labelled documents that the weights are fitted on, at most.
SAMPLE = 20_000
# Labels that are sent to every task instead of being shuffled, at most.
SENT_LABELS = 2_000_000
# Least distance from independence, in standard deviations, and documents of a screened word.
LEAST_Z, LEAST_DOCS = 5.0, 5
L1, COUNTERFACTUAL = 5e-5, 0.5
# Weight of a copy with an inserted term.
INSERTED = 0.25
# Identity terms by group, each with a neutral word that stands for no group, in the languages of the corpus.
IDENTITY = (
    ("person", ("woman", "man", "girl", "boy", "transgender", "nonbinary")),
    ("people", ("women", "men", "girls", "boys", "gays", "lesbians", "immigrants", "refugees", "foreigners")),
    ("believers", ("muslims", "christians", "jews", "hindus", "buddhists", "atheists")),
    ("religious", ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist")),
    ("human", ("black", "white", "asian", "african", "latino", "arab", "gay", "straight", "disabled", "deaf", "blind")),
    ("mensch", ("frau", "mann", "mädchen", "junge", "ausländer", "ausländerin", "flüchtling")),
    ("menschen", ("frauen", "männer", "schwule", "lesben", "einwanderer", "geflüchtete", "migranten", "behinderte")),
    ("gläubige", ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten")),
    ("menschlich", ("muslimisch", "christlich", "jüdisch", "schwarz", "weiß", "asiatisch", "afrikanisch", "arabisch", "schwul", "lesbisch", "behindert")),
    ("personne", ("femme", "homme", "fille", "garçon", "étranger", "étrangère", "réfugié", "réfugiée")),
    ("personnes", ("femmes", "hommes", "gays", "lesbiennes", "immigrés", "migrants", "étrangers", "réfugiés", "handicapés")),
    ("croyants", ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées")),
    ("humain", ("musulman", "chrétien", "juif", "noir", "blanc", "asiatique", "africain", "arabe", "homosexuel", "handicapé")),
    ("persona", ("mujer", "hombre", "chica", "chico", "extranjero", "extranjera", "refugiado", "refugiada")),
    ("personas", ("mujeres", "hombres", "gais", "lesbianas", "inmigrantes", "migrantes", "extranjeros", "refugiados", "discapacitados")),
    ("creyentes", ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos")),
    ("humano", ("musulmán", "cristiano", "judío", "negro", "blanco", "asiático", "africano", "árabe", "homosexual", "discapacitado")),
)


def bucket_of(words: Sequence[str]) -> np.ndarray:
    """Buckets of single words."""
    return _buckets(tokens.words(pa.array(list(words), pa.string())).hashes)


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 18)).astype(np.int64)


def distinct_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word buckets of every text, one after the other, and where each text begins."""
    found = tokens.words(text)
    owner = np.repeat(np.arange(len(text)), np.diff(found.first))
    keys = np.unique(owner * BUCKETS + _buckets(found.hashes))
    return keys % BUCKETS, np.searchsorted(keys // BUCKETS, np.arange(len(text) + 1))


def _class_counts(batches, schema):
    """Documents of each label that hold a word, summed over a whole partition."""
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        text, label = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        for a, b in tokens.slices(text):
            bucket, first = distinct_words(text[a:b])
            total += np.bincount(np.repeat(label[a:b], np.diff(first)) * BUCKETS + bucket, minlength=2 * BUCKETS).reshape(2, -1)
    at = np.flatnonzero(total.any(axis=0))
    yield batch_of({"bucket": at, "clean": total[0, at], "toxic": total[1, at]}, schema)


def swaps(identity=IDENTITY) -> list[tuple[int, int]]:
    """Pairs of buckets: a term and what it is swapped for."""
    out = []
    for neutral, terms in identity:
        all_words = [neutral, *terms]
        buckets = bucket_of(all_words)
        out += [(int(a), int(b)) for i, a in enumerate(buckets) for j, b in enumerate(buckets) if i and i != j]
    return out


def _rows(vocabulary: np.ndarray, identity):
    """Each sampled document as its screened words and the identity terms of its sentences, and again with a term inserted."""
    terms = bucket_of([t for _, group in identity for t in group])

    def run(batches, schema):
        for batch in batches:
            text, label, pick = batch.column(0), batch.column(1), batch.column(2).to_numpy()
            for a, b in tokens.slices(text):
                bucket, first = distinct_words(text[a:b])
                place = np.searchsorted(vocabulary, bucket)
                known = vocabulary[np.minimum(place, len(vocabulary) - 1)] == bucket
                owner = np.repeat(np.arange(b - a), np.diff(first))[known]
                words = [place[known][np.searchsorted(owner, i) : np.searchsorted(owner, i + 1)] for i in range(b - a)]
                held = np.isin(bucket, terms)
                some = set(np.repeat(np.arange(b - a), np.diff(first))[held].tolist())
                added = terms[pick[a:b] % len(terms)] if len(terms) else np.zeros(0, np.int64)
                copies = [np.union1d(w, np.searchsorted(vocabulary, t)) for w, t in zip(words, added, strict=len(terms) > 0)]
                yield batch_of(
                    {
                        "label": label[a:b], "words": words, "weight": np.ones(b - a),
                        "mentions": [_mentions(text[a + i].as_py(), terms) if i in some else [] for i in range(b - a)],
                    },
                    schema,
                )
                yield batch_of(
                    {"label": label[a : a + len(copies)], "words": copies, "weight": np.full(len(copies), INSERTED), "mentions": [[int(t)] for t in added]},
                    schema,
                )

    return run


def _mentions(text: str, terms: np.ndarray) -> list[int]:
    """Identity terms of each sentence, one entry per sentence and term."""
    for mark in "!?\n":
        text = text.replace(mark, ".")
    bucket, _ = distinct_words(pa.array(text.split("."), pa.string()))
    return bucket[np.isin(bucket, terms)].tolist()


class Model:
    """Weights of words; those that are not listed weigh nothing."""

    def __init__(self, intercept: float, buckets: np.ndarray, weights: np.ndarray):
        self.intercept = intercept
        self.table = np.zeros(BUCKETS)
        self.table[buckets] = weights

    def scores(self, text: pa.Array) -> np.ndarray:
        bucket, first = distinct_words(text)
        total = np.concatenate([[0.0], np.cumsum(self.table[bucket])])
        return 1.0 / (1.0 + np.exp(-np.clip(self.intercept + total[first[1:]] - total[first[:-1]], -500, 500)))


def fit(
    words: np.ndarray, size: np.ndarray, labels: np.ndarray, width: int, pairs: np.ndarray, times: np.ndarray,
    row_weight: np.ndarray | None = None, free: Sequence[int] = (), steps: int = 400,
) -> tuple[float, np.ndarray]:
    """Proximal gradient descent with momentum and a step for each word.

    ``words`` are the words of all rows, ``size`` of them in each, ``row_weight`` what each row counts.  ``pairs`` are swapped
    word positions (``width`` stands for a word without weight), ``times`` how often each swap occurs in the
    sample.  ``free`` words pay no L1 penalty.  Minimises the mean logistic loss, plus ``L1`` times the absolute weights,
    plus ``COUNTERFACTUAL`` times the summed squared change of all swaps over the rows.
    """
    owner = np.repeat(np.arange(len(size)), size)
    counts = np.ones(len(size)) if row_weight is None else row_weight
    n = counts.sum()
    share = (labels * counts).sum() / n
    price = np.full(width + 1, L1)
    price[list(free)] = 0
    a, b = pairs.T if len(pairs) else np.zeros((2, 0), np.int64)
    pull = 2 * COUNTERFACTUAL * times / n
    # A diagonal bound of the curvature: rare words may take long steps.
    curve = 0.25 / n * np.bincount(words, (counts * (size + 1.0))[owner], width + 1)
    curve += 2 * (np.bincount(a, pull, width + 1) + np.bincount(b, pull, width + 1))
    rate, rate_b = 1.0 / np.maximum(curve, 1e-12), 4.0 * n / (counts * (size + 1.0)).sum()
    w = np.zeros(width + 1)
    intercept = float(np.log((share * n + 0.5) / ((1 - share) * n + 0.5)))
    ahead, ahead_b, t = w, intercept, 1.0
    for _ in range(steps):
        z = ahead_b + np.bincount(owner, ahead[words], len(size))
        error = (1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))) - labels) * counts / n
        grad = np.bincount(words, error[owner], width + 1)
        change = pull * (ahead[a] - ahead[b])
        grad += np.bincount(a, change, width + 1) - np.bincount(b, change, width + 1)
        new = ahead - rate * grad
        new = np.sign(new) * np.maximum(np.abs(new) - rate * price, 0)
        new[width] = 0
        new_b = ahead_b - rate_b * error.sum()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / after * (new - w), new_b + (t - 1) / after * (new_b - intercept)
        w, intercept, t = new, new_b, after
    return intercept, w[:width]


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether a document is kept out of training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, identity=IDENTITY
) -> Model:
    """Fits on the labelled documents outside the held-out fold; ``labels`` has (doc_id, label)."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(
        F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")
    )
    small = known.count() <= SENT_LABELS
    texts = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    labelled = lambda some, sent: texts.join(F.broadcast(some) if sent else some, "_id").select("text", "label")
    counts = map_batches(labelled(known, small), _class_counts, "bucket int, clean bigint, toxic bigint")
    counts = counts.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "label").limit(sample)
    size = labelled(known, small).groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in size}
    if not n.get(0) or not n.get(1):
        share = (n.get(1, 0) + 0.5) / (n.get(0, 0) + n.get(1, 0) + 1)
        return Model(float(np.log(share / (1 - share))), np.zeros(0, np.int64), np.zeros(0))
    docs_with = F.col("clean") + F.col("toxic")
    p = docs_with / F.lit(float(n[0] + n[1]))
    z = F.abs(F.col("toxic") / n[1] - F.col("clean") / n[0]) / F.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]))
    screened = counts.where((docs_with >= LEAST_DOCS) & (p < 1)).withColumn("z", z).where(F.col("z") >= LEAST_Z)
    # At most BUCKETS numbers, whatever the size of the tables.
    vocabulary = np.array(sorted(r.bucket for r in screened.select("bucket").collect()), np.int64)
    if not len(vocabulary):
        return Model(float(np.log(n[1] / n[0])), vocabulary, np.zeros(0))
    named = bucket_of([w for neutral, group in identity for w in (neutral, *group)]) if identity else np.zeros(0, np.int64)
    vocabulary = np.union1d(vocabulary, named)
    # The sample has a fixed size, so its ids are sent to every task.
    picked = labelled(chosen, True).withColumn("pick", F.pmod(F.xxhash64("text"), F.lit(1 << 30)))
    found = map_batches(picked, _rows(vocabulary, identity), "label int, words array<int>, weight double, mentions array<int>")
    rows = found.toArrow().combine_chunks()
    mentions = np.bincount(_flat(rows["mentions"])[0], minlength=BUCKETS)
    place = {int(v): i for i, v in enumerate(vocabulary)}
    used = [(a, b) for a, b in swaps(identity) if mentions[a]]
    pairs = np.array([(place.get(a, len(vocabulary)), place.get(b, len(vocabulary))) for a, b in used], np.int64).reshape(-1, 2)
    times = np.array([mentions[a] for a, _ in used], float)
    words, size = _flat(rows["words"])
    free = np.searchsorted(vocabulary, named)
    intercept, weights = fit(words, size, rows["label"].to_numpy().astype(float), len(vocabulary), pairs, times, rows["weight"].to_numpy(), free)
    return Model(intercept, vocabulary, weights)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Elements of all lists, one after the other, and the length of each."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy())


def _score(model: Model):
    def run(batches, schema):
        for batch in batches:
            text = batch.column(1)
            for a, b in tokens.slices(text):
                yield batch_of({"_row": batch.column(0)[a:b], "score": model.scores(text[a:b])}, schema)

    return run


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every document."""
    rows = docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    scored = map_batches(rows, _score(model), "_row bigint, score double").withColumnRenamed("_row", "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the rows that the model rejects."""

    def judge(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([model.scores(texts[a:b]) for a, b in tokens.slices(texts)] or [np.zeros(0)]))

    score = F.arrow_udf(judge, "double")
    return docs.where(score(F.col(text).cast("string")) < 0.5)
