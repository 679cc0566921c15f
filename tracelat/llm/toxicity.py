"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct words (letters only, lower case) and their beginnings of 3 to 5 letters, each hashed to one
of ``BUCKETS`` numbers.  A score is the logistic function of

    w0 + sum of w[i] + sum over pairs i < j of <v[i], v[j]>

over the terms i, j that are there: beside each term's weight every pair has an interaction, the product of two short
vectors, so an insult and the mention of a group together may weigh more (or an insult and a quotation less) than the sum
of both, also for pairs that the labelled rows never show.  The pairs' sum takes one pass: half of |sum v|^2 - sum |v|^2.

Fitting: ``SAMPLE`` labelled rows at most, those with the smallest hashes of their ids (a documented bound: their ids, at
most, are broadcast, so no text is shuffled).  Map tasks count each bucket's rows by label and give sums only; the ``TERMS``
buckets that tell the labels apart best (a two-sample z statistic of their shares, at least ``LEAST`` rows) are the machine's
inputs.  Their lists for the sample, bounded by SAMPLE * TERMS numbers, come to the driver, where AdaGrad fits w and v to
the logistic loss.  The scoring pass reads every whole text once; the model (about 300 KB) is broadcast.

A null text has no terms, nor has an empty one: their score is w0's.  An id with several labels has the largest; rows that
repeat a labelled id are rows of the sample each; null labels and ids don't count.  Without labels of both kinds there are no
terms, and the score follows the labels' numbers.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelat.llm.base import stored, texts
from tracelat.llm.encode import chunks, forget

BUCKETS, TERMS, LEAST, SAMPLE = 1 << 20, 4096, 3, 30_000
BEGINNINGS = (3, 4, 5)
FACTORS, EPOCHS, BATCH, RATE, DECAY = 8, 12, 256, 0.1, 1e-5
#: Words whose terms a task keeps.
WORDS = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def buckets(word: str) -> tuple[int, ...]:
    """Those of a word and of its beginnings."""
    import xxhash

    terms = ["w" + word, *("b" + word[:n] for n in BEGINNINGS if len(word) >= n)]
    return tuple(xxhash.xxh3_64_intdigest(t.encode()) % BUCKETS for t in terms)


class Terms(dict):
    """Word to the numbers of its terms; ``number`` maps buckets to inputs, if only those count."""

    def __init__(self, number: dict[int, int] | None = None):
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= WORDS:
            self.clear()
        of = buckets(word)
        out = self[word] = of if self.number is None else tuple(self.number[b] for b in of if b in self.number)
        return out

    def of(self, text: str) -> list[int]:
        """The distinct terms of a text, ascending."""
        return sorted(set().union(*map(self.__getitem__, words(text))))


@dataclass
class Model:
    """``buckets`` of the inputs, their weights ``w`` and vectors ``v``, and ``w0``."""

    buckets: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, inputs: list[list[int]]) -> np.ndarray:
        sums = np.full(len(inputs), self.w0)
        for i, x in enumerate(inputs):
            if x:
                v = self.v[x]
                sums[i] += self.w[x].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return 1 / (1 + np.exp(-np.clip(sums, -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, target: str, rows: int) -> DataFrame:
    """label, hash and text of the labelled rows that are learned from."""
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(target).cast("int").alias("label")).dropna().groupBy("__id").agg(F.max("label").alias("label"))
    chosen = stored(known.withColumn("hash", F.xxhash64("__id")).orderBy("hash", "__id").limit(rows), "labelled")
    return texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("label", "hash", "text")  # ``rows`` ids at most


def _counted(batches):
    """bucket, negative and positive: the rows with a term in the bucket; bucket -1 stands for all rows."""
    forget()
    terms, counts, every = Terms(), np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
    for part, text in chunks(batches):
        for label, t in zip(part.column(0).to_pylist(), text):
            counts[int(label > 0), terms.of(t)] += 1
            every[int(label > 0)] += 1
    there = np.nonzero(counts.any(axis=0))[0]
    yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1)), *(pa.array(np.append(counts[k, there], every[k])) for k in (0, 1))],
                                     ["bucket", "negative", "positive"])


def _listed(number: dict[int, int]):
    def run(batches):
        forget()
        terms = Terms(number)
        for part, text in chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(map(terms.of, text), pa.list_(pa.int32()))], ["label", "hash", "inputs"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, target: str = "toxic", rows: int = SAMPLE, terms: int = TERMS) -> Model:
    """A model of the labels (positive: above 0) of at most ``rows`` labelled rows."""
    chosen = sample(docs, labels, target, rows)
    counts = stored(chosen.mapInArrow(_counted, "bucket long, negative long, positive long").groupBy("bucket").agg(
        F.sum("negative").alias("negative"), F.sum("positive").alias("positive")), "term-counts")
    n = counts.filter("bucket = -1").first()
    no, yes = (n["negative"], n["positive"]) if n else (0, 0)
    model = Model(np.empty(0, np.int64), float(np.log((yes + 0.5) / (no + 0.5) if yes else 0.5 / (no + 1))), np.zeros(0), np.zeros((0, FACTORS)))
    if not (no and yes):
        return model
    share = (F.col("negative") + F.col("positive")) / F.lit(no + yes)
    apart = F.abs(F.col("positive") / F.lit(yes) - F.col("negative") / F.lit(no)) / F.sqrt(share * (1 - share) * F.lit(1 / yes + 1 / no) + F.lit(1e-12))
    best = counts.filter((F.col("bucket") >= 0) & (F.col("negative") + F.col("positive") >= LEAST)).orderBy(apart.desc(), "bucket").limit(terms)
    model.buckets = np.array(sorted(r["bucket"] for r in best.select("bucket").collect()), np.int64)
    number = {b: i for i, b in enumerate(model.buckets.tolist())}
    # rows that repeat an id may be more than the ids: the bound holds for them too
    got = chosen.mapInArrow(_listed(number), "label int, hash long, inputs array<int>").orderBy("hash", "inputs").limit(rows).toArrow()
    return trained(model, got["inputs"].combine_chunks(), (got["label"].to_numpy() > 0).astype(np.float32))


def trained(model: Model, inputs: pa.ListArray, y: np.ndarray, seed: int = 7) -> Model:
    """``model`` with w0, w and v fitted by AdaGrad over small batches."""
    rng, n = np.random.default_rng(seed), len(model.buckets)
    flat, ends = inputs.values.to_numpy(), inputs.offsets.to_numpy()
    w0, w, v = np.float32(model.w0), np.zeros(n, np.float32), rng.normal(0, 0.02, (n, FACTORS)).astype(np.float32)
    seen0, seen_w, seen_v = 1e-6, np.full(n, 1e-6, np.float32), np.full((n, FACTORS), 1e-6, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            some = order[at : at + BATCH]
            x = np.zeros((len(some), n), np.float32)
            for i, r in enumerate(some):
                x[i, flat[ends[r] : ends[r + 1]]] = 1
            xv = x @ v
            out = w0 + x @ w + 0.5 * ((xv**2).sum(axis=1) - x @ (v**2).sum(axis=1))
            g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[some]) / len(some)
            by_term = x.T @ g
            steps = (by_term + DECAY * w, x.T @ (g[:, None] * xv) - by_term[:, None] * v + DECAY * v)
            seen0, seen_w, seen_v = seen0 + g.sum() ** 2, seen_w + steps[0] ** 2, seen_v + steps[1] ** 2
            w0, w, v = w0 - RATE * g.sum() / np.sqrt(seen0), w - RATE * steps[0] / np.sqrt(seen_w), v - RATE * steps[1] / np.sqrt(seen_v)
    return Model(model.buckets, float(w0), w.astype(np.float64), v.astype(np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        forget()
        own = shared.value
        terms = Terms({b: i for i, b in enumerate(own.buckets.tolist())})
        for part, text in chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.scores([terms.of(t) for t in text]))], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: 5 divides the CRC-32 of its decimal id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, by a model of the labelled rows that aren't held out."""
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
