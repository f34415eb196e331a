"""Language identification by sparse multinomial logistic regression on character n-grams.

Texts become L2-normed TF-IDF vectors of hashed character 1- to 3-grams.  The weights are trained
with follow-the-regularised-leader (per-coordinate rates, L1 and L2 penalties), which leaves most
of them at exactly zero; a temperature fitted on rows set aside calibrates the probabilities.

Document frequencies are counted over all documents of the training fold.  The regression is fitted
on a bounded sample of labelled rows: the same number of rows of every language (max_rows over the
number of languages, `least` or more), drawn by a hash of doc_id, and all rows of a rarer one, so that
every language with a text is learned.  Prediction reads every whole text.  lang, source and doc_id
never enter a prediction.

Cases: a text that is null or has no letter (a character of Unicode's class L; numerals and symbols
are none) gives `und` with score 0; so does every text when there
is nothing to learn from; with one language in the sample all texts with letters get it; a repeated
doc_id is predicted row by row; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import drawn_below, held_out, id_text, typed_id

BITS = 15
DIM = 1 << BITS
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]")  # letters, and numerals such as one half that are none


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram ids of a text and how often each occurs."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    one = c * np.uint32(2654435761)
    two = (one[:-1] * np.uint32(31) + c[1:]) * np.uint32(2246822519)
    three = (two[:-1] ^ (c[2:] * np.uint32(3266489917))) * np.uint32(668265263)
    counts = np.bincount(np.concatenate([one >> (32 - BITS), two >> (32 - BITS), three >> (32 - BITS)]), minlength=DIM)
    ids = np.flatnonzero(counts)
    return ids, counts[ids]


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, n = gram_counts(text)
    x = (1 + np.log(n)) * idf[ids]
    return ids, x / max(np.sqrt(x @ x), 1e-12)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _WORD.finditer(text))


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # feature by language
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        ids, x = weighted(text, self.idf)
        p = softmax((x @ self.weights[ids] + self.bias) / self.temperature)
        k = int(np.argmax(p))
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.01, epochs=3, seed=5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias; the last feature slot is the unpenalised bias."""
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))
    rng = np.random.default_rng(seed)

    def solve(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    def bias_of():
        return -z[DIM] * alpha / (beta + np.sqrt(n[DIM]))

    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            ids, x = rows[r]
            w, b = solve(z[ids], n[ids]), bias_of()
            g0 = softmax(x @ w + b)
            g0[y[r]] -= 1
            for at, old, g in ((ids, w, np.outer(x, g0)), (DIM, b, g0)):
                z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * old
                n[at] += g * g
    return solve(z[:DIM], n[:DIM]), bias_of()


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t):
        return -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()

    lo, hi, g = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Texts with a letter, and in how many of them each hashed n-gram occurs; one vector a task."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(DIM, np.int64), 0
        for pdf in batches:
            for t in pdf["_text"]:
                if has_letter(t):
                    df[gram_counts(t)[0]] += 1
                    n += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"gram": np.append(at, -1), "n": np.append(df[at], n)})

    sums = texts.select("_text").mapInPandas(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(DIM + 1, np.int64)
    df[sums["gram"].to_numpy()] = sums["n"].to_numpy()  # -1 is the last slot
    return int(df[DIM]), df[:DIM]


def train(docs: DataFrame, max_rows: int = 3000, least: int = 50, seed: int = 23) -> Model:
    """Fit on rows of the training fold that have a language."""
    learn = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), F.col("lang").alias("_lang"))
    learn = learn.filter(~held_out(F.col("_id")) & F.col("_lang").isNotNull())
    n, df = document_frequencies(learn)
    idf = np.log((1 + n) / (1 + df)) + 1
    if not n:
        return Model([], idf, np.zeros((DIM, 0)), np.zeros(0), 1.0)
    # one row a language; a text without a letter is not counted, as it cannot be learned from
    counts = learn.filter(F.col("_text").rlike(r"\p{L}")).groupBy("_lang").count().collect()
    share = max(least, max_rows // max(len(counts), 1))
    rates = docs.sparkSession.createDataFrame([(r["_lang"], drawn_below(share, r["count"])) for r in counts], "_lang string, _bound long")
    draw = F.xxhash64("_id", F.lit(seed)) <= F.col("_bound")
    drawn = learn.join(F.broadcast(rates), "_lang").filter(draw)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[[has_letter(t) for t in pdf["_text"]]]
            ids, counts = zip(*[gram_counts(t) for t in pdf["_text"]], strict=True) if len(pdf) else ((), ())
            yield pd.DataFrame({"id": pdf["_id"].to_numpy(), "lang": pdf["_lang"].to_numpy(), "f": [i.astype(np.int32) for i in ids], "n": [c.astype(np.int32) for c in counts]})

    got = drawn.select("_id", "_text", "_lang").mapInPandas(grams, "id long, lang string, f array<int>, n array<int>").toPandas().sort_values("id", kind="stable")
    langs = sorted(got["lang"].unique())
    rows = []
    for f, c in zip(got["f"], got["n"], strict=True):
        x = (1 + np.log(np.asarray(c))) * idf[np.asarray(f)]
        rows.append((np.asarray(f), x / max(np.sqrt(x @ x), 1e-12)))
    y = got["lang"].map({v: i for i, v in enumerate(langs)}).to_numpy(np.int64)
    aside = np.arange(len(rows)) % 5 == 4
    w, b = fit_ftrl([r for r, a in zip(rows, aside, strict=True) if not a], y[~aside], len(langs))
    logits = np.array([r[1] @ w[r[0]] + b for r, a in zip(rows, aside, strict=True) if a]).reshape(-1, len(langs))
    return Model(langs, idf, w, b, fit_temperature(logits, y[aside]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # DIM weights a language

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for pdf in batches:
            lang, s = zip(*[m.predict(t) for t in pdf["text"]], strict=True) if len(pdf) else ((), ())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": lang, "score": np.array(s, float)})

    return typed_id(docs.select(id_text(), "text").mapInPandas(run, "doc_id string, lang_pred string, score double"))
