"""Approximate neighbours through inverted lists around trained centroids.

The index of a document has about as many lists as the square root of its vectors (a power of four between LEAST_LISTS and MOST_LISTS), each around
one centroid; documents of like size share their centroids.  Centroids are fitted by Lloyd's steps on a bounded sample (SAMPLE_ROWS of the
vectors, by hash): tasks send partial sums, one row per centroid comes back.  Every vector of every document stands in the list of its nearest centroid,
looks into the lists of its nearest centroids, and is compared there exactly; only neighbours in other lists are missed.  Lists meet their
searchers in tiles, so a list that holds most of a document is many tasks.

How many lists are looked into is measured, not guessed: SAMPLE_SEARCHES vectors are searched exactly, and the places that the lists of their
neighbours have in their own order give the least number that holds the wanted share of neighbours.  Where vectors form groups that is a few
lists; where they lie at random, as the given ones do, neighbours lie in any list and little is saved.  ``measured`` says what was found
and compared.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators import similar
from claimloom.session import materialize

LEAST_LISTS, MOST_LISTS = 16, 4096
SAMPLE_ROWS = 65_536
ROUNDS = 6
SAMPLE_SEARCHES = 512
RECALL = 0.95
KEY = ["document_id", "namespace"]
MATCHES = similar.NEIGHBOURS


class Found(NamedTuple):
    """Neighbours with their rank, and (document_id, comparisons) of the search."""
    neighbours: DataFrame
    comparisons: DataFrame


def _unit(vectors) -> np.ndarray:
    matrix = np.stack(list(vectors)).astype(np.float64)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def train(vectors: DataFrame, lists: int, rounds: int = ROUNDS, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """At most ``lists`` unit centroids of the non-null vectors of one dimension."""
    order = F.xxhash64(*KEY, "claim_id")
    sample = materialize(vectors.orderBy(order, "claim_id").limit(sample_rows).select("claim_id", "vector"), "sample")
    centroids = _unit([r["vector"] for r in sample.orderBy(F.xxhash64("claim_id", F.lit(1)), "claim_id").limit(lists).collect()])
    for _ in range(rounds):
        def partial(frames, centroids=centroids):
            for frame in frames:
                rows = _unit(frame["vector"])
                nearest = (rows @ centroids.T).argmax(axis=1)
                for at in np.unique(nearest):
                    yield pd.DataFrame({"at": [int(at)], "total": [rows[nearest == at].sum(axis=0)]})

        def added(key, frame):
            return pd.DataFrame({"at": [key[0]], "total": [np.stack(frame["total"].to_numpy()).sum(axis=0)]})

        sums = sample.mapInPandas(partial, "at int, total array<double>").groupBy("at").applyInPandas(added, "at int, total array<double>").collect()  # one row per centroid
        for at, total in sums:
            length = np.linalg.norm(total)
            if length > 0:
                centroids[at] = np.asarray(total) / length
    return centroids


def _placed(vectors: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """``vectors`` with the number of their list and of the ``probes`` lists they look into, nearest first."""
    def nearest(frames):
        for frame in frames:
            order = np.argsort(-(_unit(frame["vector"]) @ centroids.T), axis=1, kind="stable")[:, :probes]
            yield frame.assign(list=order[:, 0].astype("int32"), looks=list(order.astype("int32")))

    return vectors.mapInPandas(nearest, "document_id string, namespace string, claim_id string, vector array<float>, list int, looks array<int>")


def probes_for(vectors: DataFrame, centroids: np.ndarray, recall: float, *, k: int, threshold: float, tile_rows: int) -> int:
    """The least number of lists that holds the share ``recall`` of the neighbours of a sample, which is searched exactly."""
    order = F.xxhash64("claim_id", *KEY)
    sample = materialize(vectors.orderBy(order, "claim_id").limit(SAMPLE_SEARCHES), "searches")
    both_ways = similar.matches_across(sample, vectors.join(sample.select(*KEY).distinct(), KEY, "left_semi"), k=k + 1, threshold=threshold, tile_rows=tile_rows)
    asked = both_ways.where(F.col("claim_id") != F.col("neighbour_id")).join(sample.select("document_id", "claim_id"), ["document_id", "claim_id"], "left_semi")
    orders = _placed(sample, centroids, len(centroids)).select("document_id", "claim_id", "looks")
    homes = _placed(vectors, centroids, 1).select("document_id", F.col("claim_id").alias("neighbour_id"), "list")
    near = similar.best_matches(asked.distinct(), k).join(orders, ["document_id", "claim_id"]).join(homes, ["document_id", "neighbour_id"])
    place = near.agg(F.expr(f"percentile(array_position(looks, list), {float(recall)})")).first()[0]
    return max(1, math.ceil(place or 1))


def _search(k: int, threshold: float):
    def best(group: pd.DataFrame) -> pd.DataFrame:
        (ids, a), (others, b) = (similar._unit_rows(group[group["looking"] == side]) for side in (True, False))
        document = group["document_id"].iat[0]
        if not len(ids) or not len(others):
            return similar._listed([], document)
        similarity = a @ b.T
        similarity[ids[:, None] == others[None, :]] = -np.inf
        compared = pd.DataFrame({"claim_id": [None], "neighbour_id": [None], "similarity": [float(np.isfinite(similarity).sum())]})
        return similar._listed([similar._top(ids, others, similarity, k, threshold), compared], document)
    return best


def index_neighbours(vectors: DataFrame, *, k: int = similar.TOP_K, threshold: float = similar.THRESHOLD, recall: float = RECALL,
                     tile_rows: int = similar.TILE_ROWS, sample_rows: int = SAMPLE_ROWS) -> Found:
    """Up to k neighbours of every claim in its document and namespace; similarities are exact, about 1 - ``recall`` of them are missed.

    With a ``recall`` of 1 all lists are looked into.  Input: document_id, namespace, claim_id, vector (null: not in the index; one dimension per call).  An empty input gives an empty result.
    """
    usable = materialize(vectors.where("vector is not null").select(*KEY, "claim_id", F.col("vector").cast("array<float>").alias("vector")), "usable")
    power = F.pow(F.lit(4.0), F.round(F.log(4.0, F.count(F.lit(1))) / 2))
    sizes = materialize(usable.groupBy(*KEY).agg(F.least(F.lit(MOST_LISTS), F.greatest(F.lit(LEAST_LISTS), power)).cast("int").alias("lists")), "sizes")
    placed = None
    for (lists,) in sizes.select("lists").distinct().orderBy("lists").collect():  # at most five values
        own = usable.join(sizes.where(F.col("lists") == lists), KEY).drop("lists")
        centroids = train(own, lists, sample_rows=sample_rows)
        probes = len(centroids) if recall >= 1 else probes_for(own, centroids, recall, k=k, threshold=threshold, tile_rows=tile_rows)
        part = materialize(_placed(own, centroids, probes), "placed")
        placed = part if placed is None else placed.unionByName(part)
    if placed is None:
        return Found(similar.top_neighbours(usable, k=k, threshold=threshold), usable.groupBy("document_id").agg(F.count(F.lit(1)).alias("comparisons")))
    group = [*KEY, "list"]
    looking = placed.select(*KEY, F.explode("looks").alias("list"), "claim_id", "vector", F.lit(True).alias("looking"))
    listed = placed.select(*group, "claim_id", "vector", F.lit(False).alias("looking"))
    tiles = lambda rows, name: rows.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / F.lit(tile_rows)).cast("int").alias(name))
    met = materialize(tiles(looking, "a").join(tiles(listed, "b"), group), "tiles")

    def dealt(rows, own, other):
        tile = F.pmod(F.xxhash64("claim_id"), F.col(own)).cast("int")
        return rows.join(met, group).select(*group, tile.alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other), "claim_id", "vector", "looking")

    cells = dealt(looking, "a", "b").unionByName(dealt(listed, "b", "a")).groupBy(*group, "a", "b")
    found = materialize(cells.applyInPandas(_search(k, threshold), MATCHES), "found")
    compared = found.where("claim_id is null").groupBy("document_id").agg(F.sum("similarity").cast("bigint").alias("comparisons"))
    return Found(similar.best_matches(found.where("claim_id is not null"), k), compared)


def measured(vectors: DataFrame, found: Found, exact: DataFrame) -> DataFrame:
    """(document_id, vectors, neighbours, recall, comparisons, exact_comparisons): the search against ``exact`` neighbours of the same vectors."""
    key = ["document_id", "claim_id", "neighbour_id"]
    hits = exact.select(*key).join(found.neighbours.select(*key, F.lit(1).alias("hit")), key, "left").groupBy("document_id").agg(
        F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("hits"))
    sizes = (vectors.where("vector is not null").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).groupBy("document_id")
             .agg(F.sum("n").alias("vectors"), F.sum(F.col("n") * (F.col("n") - 1)).alias("exact_comparisons")))
    return (sizes.join(hits, "document_id", "left").join(found.comparisons, "document_id", "left")
            .select("document_id", "vectors", F.coalesce("neighbours", F.lit(0)).alias("neighbours"), F.coalesce(F.col("hits") / F.col("neighbours"), F.lit(1.0)).alias("recall"),
                    F.coalesce("comparisons", F.lit(0)).alias("comparisons"), "exact_comparisons"))
