"""Exact top-k inner-product search by term-at-a-time accumulation.

Vectors become integers floor(256 * x).  Candidates and queries are dealt into blocks of bounded
size by a hash; every (query block, candidate block) pair is one task.  Inside it each dimension is
a term with a posting list of (candidate, weight): a query scatters its weighted postings into one
dense score array, a partition selection keeps the block's best, and the per-block winners meet in a
window that merges them.  Nothing is broadcast, and a task holds one block of each side whatever the
table's size.

Cases: vectors that are null, or hold null or non-finite components, take no part; products that
might not fit into 64 bits are added up as whole numbers of any size, and a score that does not fit
then ends the query with an error; vectors of another length are compared over the common dimensions;
ties go to the smaller vec_id; a query's own rows (same vec_id) are never candidates; repeated vec_ids
are separate candidates; a vec_id repeated among the queries with one vector is one query, with
different vectors one query for each, all under that query_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import fingerprint, shuffle_partitions

#: Rows of a block at most.
QUERIES, CANDIDATES = 16_384, 65_536


def usable(vector: str = "embedding") -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def quantized(vectors: Iterable, wide: bool) -> np.ndarray:
    """floor(256 * x) of vectors, shorter ones filled up with 0; wide: as Python's whole numbers."""
    rows = [np.floor(np.asarray(v, np.float64) * 256) for v in vectors]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), object if wide else np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = list(map(int, v)) if wide else v
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> Iterable[np.ndarray]:
    """The dense score array of each query, term at a time over sparse postings."""
    postings = []
    for t in range(candidates.shape[1]):
        at = np.flatnonzero(candidates[:, t])
        full = len(at) == len(candidates)
        postings.append((slice(None) if full else at, np.ascontiguousarray(candidates[:, t] if full else candidates[at, t])))
    for q in queries:
        scores = np.zeros(len(candidates), candidates.dtype)
        for t in np.flatnonzero(q[: len(postings)]):
            at, weight = postings[t]
            scores[at] += q[t] * weight
        yield scores


def best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        kth = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= kth]
    return np.array(sorted(at, key=lambda i: (-scores[i], ids[i]))[:k], np.int64)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, block: int = CANDIDATES, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best candidates; queries: vec_id % every = 0."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).filter(F.col("vec_id").isNotNull() & usable())
    asked = F.col("vec_id") % every == 0
    most = F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))
    n, n_asked, high, width = rows.agg(F.count("*"), F.count_if(asked), most, F.max(F.size("v"))).first()
    wide = (256.0 * (high or 0) + 1) ** 2 * (width or 0) >= 2.0**62
    n_query = max(1, -(-n_asked // query_block))
    # at least as many tasks as there are partitions; more where blocks would be larger than allowed
    n_cand = max(1, -(-n // block), min(-(-n // 1024), -(-shuffle_partitions(vectors.sparkSession) // n_query)))
    cands = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_cand)).cast("int").alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))).alias("qb"))
    queries = rows.filter(asked).withColumn("q", fingerprint("vec_id", "v")).dropDuplicates(["q"])
    queries = queries.select("vec_id", "v", F.col("q.a").alias("qa"), F.col("q.b").alias("qb2"), F.explode(F.sequence(F.lit(0), F.lit(n_cand - 1))).alias("cb"), F.pmod("q.a", F.lit(n_query)).cast("int").alias("qb"))

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(q) and len(c):
            ids = c["vec_id"].to_numpy(np.int64)
            for query, a, b, scores in zip(q["vec_id"].to_numpy(np.int64), q["qa"], q["qb2"], accumulate(quantized(q["v"], wide), quantized(c["v"], wide)), strict=True):
                out += [(query, a, b, ids[i], scores[i]) for i in best(scores, ids, ids != query, k)]
        if any(not -(2**63) <= row[4] < 2**63 for row in out):
            raise OverflowError("a score does not fit into 64 bits")
        return pd.DataFrame(out, columns=["query_id", "qa", "qb2", "vec_id", "score"]).astype("int64")

    found = queries.groupBy("qb", "cb").cogroup(cands.groupBy("qb", "cb")).applyInPandas(search, "query_id long, qa long, qb2 long, vec_id long, score long")
    order = Window.partitionBy("query_id", "qa", "qb2").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
