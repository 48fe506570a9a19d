"""Exact top-k inner products by a three-phase uniform threshold over slices of the dimensions.

The vectors are cut into ``SLICES`` slices of dimensions; the partial products of a query with one slice of all
candidates are one score list.  Queries and candidates meet in cells (a block of queries and a block of candidates), and
no cell sends more than a few rows per query.

1. Every cell sends, per query, its lowest partial score of each slice and the true scores of the k best entries of each list.
2. The k-th best true score of a query is a safe cutoff: at least k candidates reach it.  With ``low`` the sum of the lowest
   partial scores, a candidate can reach the cutoff only if in one slice it exceeds that slice's lowest score by
   (cutoff - low) / slices.  The cells collect exactly the entries above this uniform threshold.
3. Bounds leave few of them; their scores are resolved exactly and ranked, ties to the smaller identifier.

Components are integers floor(1024 * x), so sums are exact in double precision while they stay below 2**53; larger
ones are summed as 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.llm.common import chosen
from claimloom.session import materialize

SCALE = 1024
SLICES = 2
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): components floor(1024 * x); vectors that are null or hold null or non-finite components are left out."""
    v = F.transform(F.col("v"), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return (chosen(df, vec_id=id_col, v=vector_col).where(F.col("v").isNotNull() & fine & F.col("vec_id").isNotNull())
            .select("vec_id", F.transform(v, lambda x: F.floor(x * SCALE)).alias("v")))


def _matrix(rows, width: int) -> np.ndarray:
    """Rows as a matrix; shorter vectors end in zeros."""
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


def _slices(q: pd.DataFrame, c: pd.DataFrame) -> list[np.ndarray]:
    """Partial products, one matrix (queries x candidates) per slice of dimensions."""
    width = max(max(map(len, q["q"])), max(map(len, c["v"])), 1)
    a, b = _matrix(q["q"], width), _matrix(c["v"], width)
    exact = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width < 2.0 ** 53
    kind = np.float64 if exact else np.int64
    return [x.astype(kind) @ y.astype(kind).T for x, y in zip(np.array_split(a, SLICES, axis=1), np.array_split(b, SLICES, axis=1))]


def _first_phase(k: int):
    def work(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "low": [], "best": []})
        parts = _slices(q, c)
        total, ids = sum(parts), c["vec_id"].to_numpy()
        rows = []
        for i, query in enumerate(q["query_id"].tolist()):
            own = ids == query
            found: set[int] = set()
            for part in parts:
                near = min(k + int(own.sum()), len(ids))
                found.update(np.argpartition(-part[i], near - 1)[:near].tolist())
            best = sorted((int(total[i, j]) for j in found if not own[j]), reverse=True)[:k]
            rows.append((query, [int(part[i].min()) for part in parts], best))
        return pd.DataFrame(rows, columns=["query_id", "low", "best"])
    return work


def _later_phases(k: int):
    def work(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            parts = _slices(q, c)
            ids = c["vec_id"].to_numpy()
            for i, (query, cutoff, low) in enumerate(zip(q["query_id"].tolist(), q["cutoff"].tolist(), q["low"])):
                low = np.asarray(low)
                # a whole number of thresholds: (s - low) * slices >= cutoff - sum(low)
                over = [(part[i] - low[j]) * SLICES >= cutoff - low.sum() for j, part in enumerate(parts)]
                kept = np.flatnonzero(np.logical_or.reduce(over) & (ids != query))
                score = sum(part[i, kept] for part in parts)
                kept, score = kept[score >= cutoff], score[score >= cutoff]
                order = np.lexsort((ids[kept], -score))[:k]
                out += [(query, int(ids[kept[o]]), int(score[o])) for o in order]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
    return work


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query, over all rows but its own.

    Both inputs are rows of ``integer_vectors``.  Fewer than k candidates give all of them; rows with the query's own id never
    match; ties go to the smaller vec_id; equal vectors are separate candidates.  Vectors of unequal length compare
    as if the shorter ended in zeros.  Empty inputs give an empty result.  A query id given several times is one query (of
    different vectors the smallest); a candidate id given several times is a candidate each time.
    """
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    n, m = vectors.count(), queries.count()
    rows, columns = max(1, -(-m // query_block)), max(1, -(-n // candidate_block))
    deal = lambda size: F.pmod(F.xxhash64("vec_id"), F.lit(size)).cast("int")
    each = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    right = vectors.withColumn("column", deal(columns)).withColumn("row", each(rows))
    left = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), deal(rows).alias("row"))
    first = (left.withColumn("column", each(columns)).groupBy("row", "column").cogroup(right.groupBy("row", "column"))
             .applyInPandas(_first_phase(k), "query_id bigint, low array<bigint>, best array<bigint>"))
    first = materialize(first, "first")
    best = first.select("query_id", F.explode("best").alias("score")).withColumn(
        "place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("place") <= k)
    kth = best.groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("found"))
    lows = first.groupBy("query_id").agg(*[F.min(F.get("low", j)).alias(f"low{j}") for j in range(SLICES)])
    low = F.array(*[f"low{j}" for j in range(SLICES)])
    enough = F.when(F.col("found") >= k, F.col("kth"))  # fewer entries than k: everything is wanted
    bounds = materialize(lows.join(kth, "query_id", "left").select(
        "query_id", low.alias("low"), F.coalesce(enough, F.expr(" + ".join(f"low{j}" for j in range(SLICES)))).alias("cutoff")), "cutoffs")
    entries = (left.join(bounds, "query_id").withColumn("column", each(columns)).groupBy("row", "column").cogroup(right.groupBy("row", "column"))
               .applyInPandas(_later_phases(k), "query_id bigint, vec_id bigint, score bigint"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (entries.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
