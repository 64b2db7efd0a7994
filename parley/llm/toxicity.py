"""Toxicity by multiple-instance learning: a document is a bag of sentences, toxic if at least one of them is.

A sentence has probability sigmoid(b + sum of its distinct words' weights); a document's score is the noisy-or of its
sentences. Weights are learned from document labels alone, and then tell which sentences offend. A word's weight is the sum of
the weights of the word and of its first 4 to 6 letters, so that inflected forms share what they have in common.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log1p
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Codes, batches, fold, shielded, small_batches

SENTENCE = re.compile(r"[^.!?\n]+")
EDGES = ".,;:!?\"'()[]{}<>|*-_"


def features(word: str) -> list[str]:
    """The word and its first letters, from a lower-case word without punctuation at its ends."""
    bare = word.strip(EDGES)
    return [bare, *{f"{bare[:n]}*" for n in (4, 5, 6) if len(bare) > n}] if bare else []


def _softplus(z: float) -> float:
    return log1p(exp(z)) if z < 30 else z


@dataclass
class NoisyOr:
    """Weights of features and the bias of a sentence."""

    bias: float = -12.0
    weights: dict[str, float] = field(default_factory=dict)

    def word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def sentences(self, text: str, known) -> list[tuple[int, int, float]]:
        """(start, end, logit) of each sentence; an empty text is one empty sentence."""
        of = known.__getitem__
        found = [(m.start(), m.end(), self.bias + sum(map(of, set(m[0].split())))) for m in SENTENCE.finditer(text.lower())]
        return found or [(0, 0, self.bias)]


def _ratio(k: np.ndarray, k1: np.ndarray, n: int, n1: int) -> np.ndarray:
    """Likelihood ratio statistics of features in ``k`` texts, ``k1`` of them toxic, from ``n`` and ``n1``."""
    out = np.zeros(len(k))
    for seen, expected in ((k1, k * n1 / n), (k - k1, k * (n - n1) / n), (n1 - k1, (n - k) * n1 / n), (n - n1 - k + k1, (n - k) * (n - n1) / n)):
        out += np.where(seen > 0, 2 * seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return out


def dependent(texts: list[str], toxic: np.ndarray, evidence: float) -> list[str]:
    """The features whose presence in a text depends on its label. They are screened by hash first, so that only those that may pass are held by name."""
    size, n, n1 = 1 << 20, len(texts), int(toxic.sum())
    cells = Codes(lambda w: [crc32(f.encode()) % size for f in features(w)], 50_000)
    k, k1 = np.zeros(size), np.zeros(size)
    for text, label in zip(texts, toxic):
        at = np.fromiter({c for w in set(text.lower().split()) for c in cells[w]}, np.int64)
        k[at] += 1
        k1[at] += label
    # cells shared by several features dilute what each shows: half of the evidence lets them through to the exact count
    open_ = set(np.flatnonzero(_ratio(k, k1, n, n1) >= evidence / 2).tolist())
    held = Codes(lambda w: [f for f in features(w) if crc32(f.encode()) % size in open_], 50_000)
    both: tuple[Counter, Counter] = Counter(), Counter()
    for text, label in zip(texts, toxic):
        found = {f for w in set(text.lower().split()) for f in held[w]}
        both[0].update(found)
        if label:
            both[1].update(found)
    names = sorted(both[0])
    g = _ratio(np.array([both[0][f] for f in names]), np.array([both[1][f] for f in names]), n, n1) if names else np.zeros(0)
    return [f for f, x in zip(names, g) if x >= evidence]


def learn(texts: list[str], toxic: np.ndarray, weight: np.ndarray, evidence: float = 20.0, epochs: int = 200, rate: float = 0.15, ridge: float = 1e-4) -> NoisyOr:
    """Fit by Adam on the weighted log-likelihood of the bags. Only features whose presence in a text depends on the label get a weight:
    those with a likelihood ratio statistic of ``evidence`` or more, which one in 100,000 unrelated ones reaches."""
    if not len(texts) or not 0 < toxic.sum() < len(texts):
        return NoisyOr()
    order = dependent(texts, toxic, evidence)
    names = {f: i for i, f in enumerate(order)}
    held = Codes(lambda w: [names[f] for f in features(w) if f in names], 50_000)
    inside, sentence, bag = [], [], []
    for number, text in enumerate(texts):
        for part in SENTENCE.findall(text.lower()) or [""]:
            at = [i for w in set(part.split()) for i in held[w]]
            inside += at
            sentence += [len(bag)] * len(at)
            bag.append(number)
    inside, sentence, bag = (np.array(x, dtype=np.int64) for x in (inside, sentence, bag))
    x, bias = np.zeros(len(names)), -6.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    weight = weight / weight.sum()
    for step in range(1, epochs + 1):
        z = np.clip(bias + np.bincount(sentence, x[inside], len(bag)), -40, 40)
        total = np.maximum(np.bincount(bag, np.log1p(np.exp(z)), len(texts)), 1e-12)  # -log P(clean)
        slope = weight * np.where(toxic == 1, -1 / np.expm1(np.minimum(total, 500)), 1.0)
        each = slope[bag] / (1 + np.exp(-z))
        g = np.append(np.bincount(inside, each[sentence], len(names)) + ridge * x, each.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
        x, bias = x - move[:-1], bias - move[-1]
    return NoisyOr(float(bias), {order[i]: float(x[i]) for i in np.flatnonzero(np.abs(x) > 1e-3)})


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, most: int = 3000, most_bytes: int = 8 << 20) -> NoisyOr:
    """Learn from labelled documents outside the held-out fold. The driver takes at most about ``most`` documents and ``most_bytes`` of text of each class, chosen by a hash of the id; they are
    weighted to stand for all of their class. Null labels and ids teach nothing; a document labelled twice counts twice;
    with no label of either class every score is near 0.
    """
    usable = labels.where("toxic in (0, 1) and doc_id is not null").where(fold("doc_id", folds) != held).select("doc_id", "toxic")
    share = {r["toxic"]: min(1.0, most / r["count"]) for r in usable.groupBy("toxic").count().collect()}
    if len(share) < 2:
        return NoisyOr()
    point = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = usable.where(point < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    # about 2 * most ids are broadcast, so that no text is moved but those of the sample
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    for r in joined.groupBy("toxic").agg(F.sum(F.octet_length("text")).alias("b")).collect():
        share[r["toxic"]] *= min(1.0, most_bytes / max(r["b"], 1))
    part = joined.where(point < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    rows = sorted((r["doc_id"], r["toxic"], r["text"]) for r in part.collect())
    toxic = np.array([r[1] for r in rows])
    weight = np.array([1 / share[t] for t in toxic]) if rows else np.zeros(0)
    return learn([r[2] for r in rows], toxic, weight)


RESULTS = ("score", "predicted", "n_sentences", "worst_start", "worst_end", "worst_probability")


def score(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """``docs`` with score (0 to 1), predicted (1 from 0.5), n_sentences, worst_start, worst_end and worst_probability (characters of the likeliest
    sentence). Whole texts count; null and empty ones are one empty sentence. Other columns pass through, those named like the results are replaced."""
    small_batches(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast(model)
    own = "score double, predicted int, n_sentences int, worst_start int, worst_end int, worst_probability double"
    names = [c.split()[0] for c in own.split(", ")]
    kinds = (pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    kept = [f for f in docs.schema.fields if f.name not in names]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = share.value
        known = Codes(model.word, 300_000)
        for table in batches(frames, 4 << 20):
            out = []
            for text in table.column("text").to_pylist():
                found = model.sentences(text or "", known)
                start, end, z = max(found, key=lambda s: s[2])
                p = -np.expm1(-sum(_softplus(s[2]) for s in found))
                out.append((p, int(p >= 0.5), len(found), start, end, 1 / (1 + exp(-max(z, -500)))))
            columns = [table.column(f.name).combine_chunks() for f in kept] + [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
            yield from pa.table(columns, names=[f.name for f in kept] + names).to_batches()

    return docs.select(*[f.name for f in kept]).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", " + own)


def offending_sentences(docs: DataFrame, model: NoisyOr, least: float = 0.5) -> DataFrame:
    """The sentences whose own probability is at least ``least``: doc_id, start, end (characters), probability, sentence."""
    share = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = share.value
        known = Codes(model.word, 300_000)
        for frame in batches(frames, 4 << 20):
            found = [(row, s, e, 1 / (1 + exp(-max(z, -500))), text[s:e]) for row, text in enumerate(frame.column("text").to_pylist()) if text for s, e, z in model.sentences(text, known)]
            found = [f for f in found if f[3] >= least]
            columns = [pa.array([f[i] for f in found], k) for i, k in ((1, pa.int32()), (2, pa.int32()), (3, pa.float64()), (4, pa.string()))]
            ids = frame.column("doc_id").combine_chunks().take(pa.array([f[0] for f in found], pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "start", "end", "probability", "sentence"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start int, end int, probability double, sentence string")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` that a model learned from ``labels`` does not predict to be toxic. Its columns keep their values, those named like the results of ``score`` too."""
    safe, own = shielded(docs, RESULTS)
    return own(score(safe, fit(docs, labels)).where("predicted = 0"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model).withColumn("held_out", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)))
    return scored.select("doc_id", "held_out", "score", "predicted", "n_sentences", "worst_start", "worst_end", "worst_probability")
