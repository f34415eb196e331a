"""Toxicity by non-negative positive-unlabelled learning.

A linear numpy classifier is fitted from confirmed toxic examples P and unlabelled text U.  With
class prior pi its risk is  pi * R(P, +) + max(0, R(U, -) - pi * R(P, -)):  the negative part is
estimated from U with the share of positives taken out, and held at zero or above; where it falls
below, the step goes against it instead.  Loss: logistic, so that the margin is a log-odds.

Features are words and word beginnings: present or not, and how dense.  The `keep` features that
stand out most among the positives are the model; `least` positives must have them, and their rate
must be `ratio` times that of U: three documented parameters of the model's size.  The prior is the
share of toxic rows among the labelled rows of the training fold.

P is a bounded sample of labelled rows (max_positive, drawn by a hash of doc_id).  U is the whole
training fold: feature counts and the prior cover it, and so do the last steps of the fit, each of
which adds up risk and gradient over all its rows in Spark.  They start from a fit whose U is a
sample (max_unlabelled).  Scoring reads every whole text.  labels, lang, source and doc_id never
enter a score.

Cases: null and empty texts have no feature and get the bias alone; with no toxic example to learn
from all scores are 0; a label of null is no label; a repeated doc_id is scored row by row and takes
part in the fit row by row; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import drawn_below, held_out, id_text, stored, typed_id

_WORD = re.compile(r"[^\W\d_]+")
DIM = 1 << 20


class Features:
    """Hashed ids of the words of a text and of their first five letters; a bounded word table."""

    def __init__(self, chosen: np.ndarray | None = None):
        self.known: dict[str, tuple[int, ...]] = {}
        self.place = None if chosen is None else {int(i): k for k, i in enumerate(chosen)}

    def _of(self, word: str) -> tuple[int, ...]:
        """The word's features; where some are chosen, their places among these."""
        if len(self.known) > 300_000:
            self.known.clear()
        both = (zlib.crc32(word.encode()) % DIM, zlib.crc32(b"^" + word[:5].encode()) % DIM)
        got = self.known[word] = both if self.place is None else tuple(self.place[i] for i in both if i in self.place)
        return got

    def counts(self, text: str | None) -> tuple[dict[int, int], int]:
        """How often each feature occurs, and the number of words."""
        words = Counter(_WORD.findall(text.lower())) if text else {}
        get, out = self.known.get, {}
        for w, n in words.items():
            of = get(w)
            for i in self._of(w) if of is None else of:
                out[i] = out.get(i, 0) + n
        return out, sum(words.values())

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Features that occur, ascending, and how dense each is: log(1 + occurrences in 100 words)."""
        counts, words = self.counts(text)
        ids = np.array(sorted(counts), np.int64)
        return ids, np.log1p(100 * np.array([counts[i] for i in ids.tolist()], float) / max(words, 1))


Docs = list[tuple[np.ndarray, np.ndarray]]
Risk = Callable[[np.ndarray, float], tuple[float, np.ndarray]]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Sparse:
    """Documents as one sparse matrix: presence in the first d columns, density in the next d."""

    def __init__(self, docs: Docs, d: int):
        row = np.repeat(np.arange(len(docs)), [len(i) for i, _ in docs])
        col = np.concatenate([i for i, _ in docs]) if docs else np.zeros(0, np.int64)
        x = np.concatenate([x for _, x in docs]) if docs else np.zeros(0)
        self.n, self.d, self.row, self.col, self.x = len(docs), d, np.append(row, row), np.append(col, col + d).astype(np.int64), np.append(np.ones(len(x)), x)

    def margins(self, w: np.ndarray, b: float) -> np.ndarray:
        return b + np.bincount(self.row, w[self.col] * self.x, minlength=self.n)

    def gradient(self, g: np.ndarray) -> np.ndarray:
        """By weights and bias, from the derivative by each document's margin."""
        return np.append(np.bincount(self.col, g[self.row] * self.x, minlength=2 * self.d), g.sum())

    def negative(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        """The documents' summed loss as negatives, and its gradient."""
        z = self.margins(w, b)
        return float(np.logaddexp(0, z).sum()), self.gradient(_sigmoid(z))


@dataclass
class Model:
    """The chosen features, the weights of their presence and of their density, bias and class prior."""

    chosen: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, docs: Docs) -> np.ndarray:
        """sigmoid(bias + weights) of documents, as Features(chosen) gives them."""
        if not self.prior:
            return np.zeros(len(docs))
        return _sigmoid(Sparse(docs, len(self.chosen)).margins(self.weights, self.bias))


NOTHING = Model(np.zeros(0, np.int64), np.zeros(0), 0.0, 0.0)


def select_features(learn: DataFrame, pos: DataFrame, n_pos: int, n_unl: int, keep: int = 512, least: int = 3, ratio: float = 3.0) -> np.ndarray:
    """The features that stand out among the positives, by how surely their rate is higher there.

    learn: all unlabelled rows; pos: the positives; both with _text.  Each task sends one count for
    each feature it met; the comparison runs in Spark, and only the chosen ids reach the driver.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, seen = Features(), np.zeros((2, DIM), np.int32)
        for pdf in batches:
            for positive, text in zip(pdf["_p"], pdf["_text"], strict=True):
                seen[0 if positive else 1, list(of.counts(text)[0])] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pd.DataFrame({"f": at.astype(np.int32), "p": seen[0, at].astype(np.int64), "u": seen[1, at].astype(np.int64)})

    sets = pos.select("_text", F.lit(True).alias("_p")).unionByName(learn.select("_text", F.lit(False).alias("_p")))
    sums = sets.mapInPandas(count, "f int, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).filter(F.col("p") >= least)
    odds = (F.col("p") / n_pos) / ((F.col("u") + 1) / (n_unl + 1))
    best = sums.withColumn("odds", odds).filter(F.col("odds") > ratio).orderBy(F.desc(F.col("p") * F.log("odds")), "f").limit(keep)
    return np.sort(np.array([r.f for r in best.select("f").collect()], np.int64))


def risk(pos: Sparse, unlabelled: Risk, prior: float, w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
    """The non-negative risk, and the direction to step against.  unlabelled: mean loss of U as negatives, and its gradient."""
    z = pos.margins(w, b)
    loss, g_neg = unlabelled(w, b)
    negative = loss - prior * float(np.logaddexp(0, z).mean())
    g_neg = g_neg - pos.gradient(prior * _sigmoid(z) / pos.n)
    g = pos.gradient(prior * (_sigmoid(z) - 1) / pos.n) + g_neg if negative >= 0 else -g_neg
    return prior * float(np.logaddexp(0, -z).mean()) + max(0.0, negative), g


def descend(pos: Sparse, unlabelled: Risk, prior: float, w: np.ndarray, b: float, steps: int, rate: float, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk."""
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        g = risk(pos, unlabelled, prior, w, b)[1]
        g[:-1] += l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return w, b


def _mean(docs: Sparse, empty: int) -> Risk:
    """The risk of documents on the driver, of which `empty` more have no feature."""
    n = max(docs.n + empty, 1)

    def at(w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        loss, g = docs.negative(w, b)
        g[-1] += empty * float(_sigmoid(np.array(b)))
        return (loss + empty * float(np.logaddexp(0, b))) / n, g / n

    return at


def _corpus(compact: DataFrame, n: int, d: int) -> Risk:
    """The risk of n rows in Spark; compact holds those with a feature.  2 d + 3 sums reach the driver."""

    def at(w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(2 * d + 3)
            for pdf in batches:
                docs = Sparse([(np.asarray(f, np.int64), np.asarray(x, float)) for f, x in zip(pdf["f"], pdf["x"], strict=True)], d)
                loss, g = docs.negative(w, b)
                total += np.concatenate([g, [loss, docs.n]])
            yield pd.DataFrame({"at": np.arange(len(total)), "v": total})

        sums = np.zeros(2 * d + 3)
        for r in compact.select("f", "x").mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v")).collect():
            sums[r[0]] = r[1]
        empty = n - sums[-1]
        sums[2 * d] += empty * float(_sigmoid(np.array(b)))
        return (sums[-2] + empty * float(np.logaddexp(0, b))) / n, sums[: 2 * d + 1] / n

    return at


def fit_nnpu(pos: Docs, unl: Docs, chosen: np.ndarray, prior: float, empty: int = 0, steps: int = 500, rate: float = 0.05) -> Model:
    """Fit on documents on the driver, as Features(chosen) gives them; `empty` more of U have no feature."""
    if not pos or not prior:
        return NOTHING
    d = len(chosen)
    w, b = descend(Sparse(pos, d), _mean(Sparse(unl, d), empty) if unl or empty else _mean(Sparse(pos, d), 0), prior, np.zeros(2 * d), float(np.log(prior / (1 - prior))), steps, rate)
    return Model(chosen, w, b, prior)


def _rows(frame: pd.DataFrame) -> Docs:
    return [(np.asarray(f, np.int64), np.asarray(x, float)) for f, x in zip(frame["f"], frame["x"], strict=True)]


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 6000, max_unlabelled: int = 12000, last_steps: int = 8, seed: int = 17) -> Model:
    """Fit on the training fold: confirmed toxic rows against rows whatever their label."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").alias("_toxic")).filter("_id IS NOT NULL AND _toxic IS NOT NULL")
    known = known.filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    learn = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text")).filter(~held_out(F.col("_id")))
    here = learn.select("_id").join(known, "_id", "left").agg(
        F.count("*").alias("n"), F.count("_toxic").alias("labelled"), F.count_if(F.col("_toxic") == 1).alias("toxic")
    )
    n, labelled, toxic = here.first()
    if not toxic:
        return NOTHING
    confirmed = known.filter(F.col("_toxic") == 1).select("_id")
    draw = F.xxhash64("_id", F.lit(seed)) <= drawn_below(max_positive, confirmed.count())
    drawn = F.broadcast(confirmed.filter(draw))  # about max_positive ids at most, however many are labelled
    pos = learn.join(drawn, "_id", "left_semi")
    n_pos = pos.count()
    chosen = select_features(learn, pos, n_pos, n)

    def featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Features(chosen)
        for pdf in batches:
            rows = [of(t) for t in pdf["_text"]]
            some = [k for k, (ids, _) in enumerate(rows) if len(ids)]
            if some:  # an empty column would have no type
                yield pd.DataFrame({"id": pdf["_id"].iloc[some], "f": [rows[k][0].astype(np.int32) for k in some], "x": [rows[k][1].astype(np.float32) for k in some]})

    wanted = "id long, f array<int>, x array<float>"
    compact = stored(learn.mapInPandas(featurize, wanted))  # a few numbers for each row with a chosen feature
    share = min(1.0, max_unlabelled / n)
    other = F.xxhash64("id", F.lit(seed + 1)) <= drawn_below(max_unlabelled, n)
    positive = _rows(compact.join(drawn.withColumnRenamed("_id", "id"), "id", "left_semi").orderBy("id").toPandas())
    positive += [(np.zeros(0, np.int64), np.zeros(0))] * (n_pos - len(positive))
    if not positive:
        return NOTHING
    sample = _rows(compact.filter(other).orderBy("id").toPandas())
    prior = min(toxic / labelled, 0.99)
    model = fit_nnpu(positive, sample, chosen, prior, empty=round(share * (n - compact.count())))
    w, b = descend(Sparse(positive, len(chosen)), _corpus(compact, n, len(chosen)), prior, model.weights, model.bias, last_steps, rate=0.01)
    return Model(chosen, w, b, prior)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted for every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most `keep` features

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        of = Features(m.chosen)
        for pdf in batches:
            s = m.scores([of(t) for t in pdf["text"]])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    return typed_id(docs.select(id_text(), "text").mapInPandas(run, "doc_id string, score double, predicted int"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns as they are, that score below the threshold."""
    held, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        of = Features(m.chosen)
        for batch in batches:
            yield batch.filter(pa.array(m.scores([of(t) for t in batch.column("text").to_pylist()]) < threshold, pa.bool_()))

    return docs.mapInArrow(run, schema)
