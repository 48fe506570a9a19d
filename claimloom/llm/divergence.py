"""Source divergence audit over hash-consed segment trees.

A group is one (language, source); its counts over the kept terms of the language are the leaves of a segment tree over term ids.  A term
id is (block, place): blocks take about ``BLOCK`` terms each by hash, places follow the number of documents, so that rare
terms, which most groups lack, stand together.  The trees are cut at the roots of the blocks.

1. Tasks count terms per group; sums give the kept terms, their ids, and the total of every group.
2. The subtrees of one block of all groups are built together, level by level from the leaves: equal pairs of children are one node, whichever
   group and place they are from, so a node number stands for a sequence of counts.
3. All pairs of groups are traversed at once.  A front holds the node pairs that a group pair has reached and how often; equal pairs are one
   entry, so each is taken apart once, and what is left at the leaves is how often a group pair has each pair of counts.  Empty subtrees are
   never entered.
4. Spark adds up the pairs of counts of all blocks and prices each of them once per group pair, in both directions.  Terms that one group
   lacks follow from the other's counts (each priced against 0 as if alone, taken back where both have the term), and those that both lack from V.

Sources meet in tiles of ``TILE``, so that a task holds the subtrees of two tiles however many sources a language has.  All arithmetic is in
whole numbers.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.llm.common import chosen
from claimloom.session import materialize

LEAST_DOCUMENTS = 3
TERM_RANKS = 200
SCALE = 1_000_000_000
BLOCK = 1024
TILE = 32
BUFFER = 1 << 20  # distinct terms of groups added up at once in a task
FRONT = 1 << 21  # node pairs of one front
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), stored; a null term stands for the group itself, so that groups without terms are there, too."""
    def rows(counts: dict[tuple, Counter], holders: dict[tuple, Counter]) -> pa.RecordBatch:
        flat = [(*group, term, n, holders[group][term]) for group, found in counts.items() for term, n in found.items()]
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], kind) for i, kind in enumerate(kinds)], names=["lang", "source", "term", "n", "docs"])

    def work(batches):
        counts: dict[tuple, Counter] = {}
        holders: dict[tuple, Counter] = {}
        for batch in batches:
            for lang, source, text in zip(*[c.to_pylist() for c in batch.columns]):
                group = (lang or "", source or "")
                terms = (text or "").encode().translate(_TABLE).split()
                counts.setdefault(group, Counter({None: 0})).update(terms)
                holders.setdefault(group, Counter()).update(set(terms))
            if sum(map(len, counts.values())) > BUFFER:
                yield rows(counts, holders)
                counts, holders = {}, {}
        yield rows(counts, holders)

    found = docs.select("lang", "source", "text").mapInArrow(work, "lang string, source string, term binary, n bigint, docs bigint")
    return materialize(found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")


def kept_terms(counts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, term, total, block, place) of the terms in at least ``least`` documents, and (lang, v, lang_n) of every language; stored."""
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    terms = materialize(terms, "terms")
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    langs = counts.select("lang").distinct().join(sizes, "lang", "left").select("lang", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("v", "lang_n")])
    langs = materialize(langs, "langs")
    blocks = F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / BLOCK))
    place = F.row_number().over(Window.partitionBy("lang", "block").orderBy(F.desc("docs"), "term")) - 1
    placed = terms.join(langs.select("lang", "v"), "lang").withColumn("block", blocks).withColumn("place", place)
    return materialize(placed.select("lang", "term", "total", "block", "place"), "kept"), langs


def _subtrees(rows: pd.DataFrame, groups: pd.Index) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Node numbers of the subtree roots, and from the leaves up the children of each node: [(left, right) arrays] with node 0 empty.

    Level 0 nodes are counts by their rank among the distinct ones.
    """
    width = 1 << max(int(rows["place"].max()), 1).bit_length()
    leaves = np.zeros((len(groups), width), np.int64)
    leaves[groups.get_indexer(rows["source"]), rows["place"].to_numpy()] = rows["n"].to_numpy()
    values, numbers = np.unique(np.append(0, leaves), return_inverse=True)
    nodes, below = numbers[1:].reshape(leaves.shape), []
    while nodes.shape[1] > 1:
        size = int(nodes.max(initial=0)) + 1
        pairs, numbers = np.unique(np.append(0, nodes[:, ::2] * size + nodes[:, 1::2]), return_inverse=True)
        below.append((pairs // size, pairs % size))
        nodes = numbers[1:].reshape(len(groups), -1)
    return nodes[:, 0], [values, *below]


def _count_pairs(roots: np.ndarray, tree: list, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
    """(group pair, left count, right count, times) of all group pairs where both counts are above 0, by one front over all of them."""
    pair, a, b = np.arange(len(left)), roots[left], roots[right]
    times = np.ones(len(left), np.int64)
    for level in [*reversed(tree[1:]), None]:
        open_ = (a != 0) & (b != 0)
        pair, a, b, times = pair[open_], a[open_], b[open_], times[open_]
        if level is None:
            return pair, tree[0][a], tree[0][b], times
        pair, times = np.concatenate([pair, pair]), np.concatenate([times, times])
        a, b = np.concatenate([level[0][a], level[1][a]]), np.concatenate([level[0][b], level[1][b]])
        high = int(max(a.max(initial=0), b.max(initial=0))) + 1
        _, first, at = np.unique((pair * high + a) * high + b, return_index=True, return_inverse=True)
        pair, a, b, times = pair[first], a[first], b[first], np.bincount(at, times, len(first)).astype(np.int64)


def _block_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """The count pairs of one block of one tile pair."""
    low, high = int(rows["tile"].iloc[0]), int(rows["meets"].iloc[0])
    groups = pd.Index(rows["source"].unique())
    home = rows.drop_duplicates("source").set_index("source")["home"].reindex(groups).to_numpy()
    roots, tree = _subtrees(rows, groups)
    found = []
    low_side, high_side = np.flatnonzero(home == low), np.flatnonzero(home == high)
    step = max(1, FRONT // max(1, len(high_side) << len(tree)))
    for start in range(0, len(low_side), step):
        x, y = (g.ravel() for g in np.meshgrid(low_side[start:start + step], high_side, indexing="ij"))
        if low == high:
            x, y = x[x < y], y[x < y]
        pair, p, q, times = _count_pairs(roots, tree, x, y)
        found.append(pd.DataFrame({"source": groups.to_numpy()[x[pair]], "other": groups.to_numpy()[y[pair]], "n": p, "m": q, "times": times}))
    out = pd.concat(found)
    out.insert(0, "lang", rows["lang"].iloc[0])
    return out


def count_pairs(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """(lang, source, other, n, m, times) for one order of every two sources of a language: how many kept terms have these counts, both above 0."""
    tiles = sources.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    homes = sources.join(tiles, "lang").select("lang", "source", F.pmod(F.xxhash64("source"), "tiles").alias("home"), "tiles")
    dealt = cells.join(homes, ["lang", "source"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("lang", "block", F.least("home", "other").alias("tile"), F.greatest("home", "other").alias("meets"), "home", "source", "place", "n")
    pairs = dealt.groupBy("lang", "block", "tile", "meets").applyInPandas(_block_pairs, "lang string, source string, other string, n bigint, m bigint, times bigint")
    one_way = pairs.select("lang", F.least("source", "other").alias("source"), F.greatest("source", "other").alias("other"),
                           F.when(F.col("source") < F.col("other"), F.col("n")).otherwise(F.col("m")).alias("n"),
                           F.when(F.col("source") < F.col("other"), F.col("m")).otherwise(F.col("n")).alias("m"), "times")
    return one_way.groupBy("lang", "source", "other", "n", "m").agg(F.sum("times").alias("times"))


def share(n: str | Column, total: str, v: str = "v") -> Column:
    """1 + floor(SCALE * (n + 1) / (total + v)), in decimals: the product may pass 64 bits."""
    part = ((F.col(n) if isinstance(n, str) else n) + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    whole = F.col(total) + F.col(v)
    return F.call_function("div", part, whole.cast("decimal(19,0)")) + 1


def divergence(p: str, q: str) -> Column:
    """floor((p - q)^2 / q); shares are at most SCALE + 1, so the square fits 64 bits."""
    return F.call_function("div", (F.col(p) - F.col(q)) * (F.col(p) - F.col(q)), F.col(q))


def pair_values(met: DataFrame, single: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, other, there, back) for one order of every two sources: divergences over all kept terms, from one side and from the other.

    ``single`` (lang, source, n, times) says how many kept terms a group has n times, n above 0.  A sum over all terms is that of each group
    alone against 0, plus for ``met`` what both counts together differ from both alone; it never exceeds a few times SCALE squared.
    """
    others = groups.select("lang", F.col("source").alias("other"), F.col("group_n").alias("other_n"), F.col("held").alias("other_held"))
    both = groups.join(others, "lang").where(F.col("source") < F.col("other")).select("lang", "source", "other", "group_n", "other_n", "held", "other_held", "v")
    zero = F.lit(0).cast("bigint")
    key = ["lang", "source", "other"]
    rows = (met.select(*key, "n", "m", "times", F.lit(True).alias("together")).join(both, key)
            .unionByName(single.join(both, ["lang", "source"]).select(*both.columns, "n", zero.alias("m"), "times", F.lit(False).alias("together")))
            .unionByName(single.select("lang", F.col("source").alias("other"), F.col("n").alias("m"), "times").join(both, ["lang", "other"])
                         .select(*both.columns, zero.alias("n"), "m", "times", F.lit(False).alias("together")))
            .unionByName(both.select("*", zero.alias("n"), zero.alias("m"), (F.col("v") - F.col("held") - F.col("other_held")).alias("times"), F.lit(False).alias("together"))))
    for name, n, total in (("p", F.col("n"), "group_n"), ("p0", zero, "group_n"), ("q", F.col("m"), "other_n"), ("q0", zero, "other_n")):
        rows = rows.withColumn(name, F.when(F.col("v") > 0, share(n, total)))
    alone = lambda x, y: F.when(F.col("together"), divergence(x, f"{y}0") + divergence(f"{x}0", y) - divergence(f"{x}0", f"{y}0")).otherwise(0)
    value = lambda x, y: F.coalesce(F.sum(F.col("times") * (divergence(x, y) - alone(x, y))), zero)
    return rows.groupBy(*key).agg(value("p", "q").alias("there"), value("q", "p").alias("back"))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far every group is from the other sources and from its language.

    Part ``pair`` has a row for each other source of the language with the summed divergence over all kept terms; part ``term`` the
    kept terms that the group uses more than its language, the first ``ranks``.  Null languages, sources and texts are empty.  Terms are
    runs of letters A-Z (lower-cased) and of characters beyond ASCII.  Repeated rows are documents of their own; groups without terms
    take part with counts of 0; a language without kept terms has pairs of value 0.  An empty table gives an empty result; further
    columns are ignored.
    """
    docs = chosen(docs, lang=lang_col, source=source_col, text=text_col)
    counts = term_counts(docs)
    kept, langs = kept_terms(counts, least)
    cells = materialize(counts.where("term is not null").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total", "block", "place"), "cells")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count(F.lit(1)).alias("held"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang")
    groups = materialize(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("group_n", "held")], "v", "lang_n"), "groups")

    met = materialize(count_pairs(cells.select("lang", "source", "block", "place", "n"), groups.select("lang", "source")), "count_pairs")
    sums = pair_values(met, cells.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("times")), groups)
    ways = F.array(F.struct("source", F.col("other").alias("item"), F.col("there").alias("value")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))
    pairs = sums.select("lang", F.explode(ways).alias("w")).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "w.value")

    used = cells.join(groups, ["lang", "source"]).withColumn("p", share("n", "group_n")).withColumn("q", share("total", "lang_n")).where("p > q")
    terms = used.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= ranks))
