"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents with the same words in the same order are one class; the join runs over classes.  A set x that reaches similarity t with any
other shares at least m(x) = ceil(t |x|) elements with it.  Under one global order of all elements, the first |x| - m(x) + l
elements of both sets then share at least l, for every level l (the l-prefixes).

1. Every class gives its prefix of the basic level l(x) = 1 + |x| / 20 in hash order.  A class of which fewer than l elements occur in any
   other prefix has no partner.  Of the elements that do occur elsewhere, the rarest are kept: all but the last l - 1, because
   any l common elements have one among them.  l is taken for the smallest partner a class can have.
2. The estimated cost of a class is the number of candidates behind these elements.  Elements shared by at most ``CHEAP`` classes give their
   pairs at once.  Classes with a dearer element get their prefix lengthened to the whole set, which asks for m(x) shared
   elements: the rarest |x| - m(x) + 1 are kept, most of which are unique to the class and therefore ask nobody.  Two classes can
   share no more than what each shares with any other, which rules out most of the rest without reading a set.
3. Candidates are verified on their whole sets.  In a dear group each class is first compared with the class of its element
   that differs least from the group; only pairs that these links leave in different components are compared after that.

Links between classes make components; no pair inside a component is needed beyond those that hold it together.  A class is told by 128
bits of a cryptographic digest of its words; words and shingles are compared by keyed 64-bit hashes, so two documents of n shingles are
misjudged with a chance below n * n / 2**64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.llm.common import chosen, texts_of
from claimloom.llm.components import components
from claimloom.llm.shingles import sequence_digest, shingle_set, words_of
from claimloom.session import materialize

SHINGLE = 4
PERCENT = 85
LEVEL_STEP = 20
CHEAP = 8
BROADCAST_IDS = 2_000_000  # 16 bytes each


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def class_prefixes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, digest, size, prefix): class of each text, number of distinct shingles, and its basic prefix."""
    def work(batches):
        for batch in batches:
            digests, sizes, prefixes = [], [], []
            for words in words_of(texts_of(batch.column(1))):
                s = shingle_set(words, n)
                size = len(s)
                digests.append(sequence_digest(words))
                sizes.append(size)
                prefixes.append(_signed(s[:min(size, size - -(-percent * size // 100) + 1 + size // LEVEL_STEP)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                                             names=["doc_id", "digest", "size", "prefix"])

    return docs.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest binary, size bigint, prefix array<bigint>")


def classes_of(prefixes: DataFrame) -> DataFrame:
    """(node, digest, size, prefix, doc_id) of every class with words, stored; nodes are numbers given once, the id is the smallest."""
    found = prefixes.where("size > 0").groupBy("digest").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.min("doc_id").alias("doc_id"))
    return materialize(found.withColumn("node", F.monotonically_increasing_id()), "classes")


def class_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, size, set) of the ``wanted`` (doc_id, node, digest), from their whole texts; one row per node."""
    few = wanted.count() <= BROADCAST_IDS
    named = docs.join(F.broadcast(wanted) if few else wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"])).select("node", "text", "digest")

    def work(batches):
        for batch in batches:
            rows = [(node, _signed(shingle_set(words, n))) for node, digest, words in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), words_of(texts_of(batch.column(1))))
                    if sequence_digest(words) == digest]  # an id may name several texts
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()),
                                              pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["node", "size", "set"])

    sets = materialize(named.mapInArrow(work, "node bigint, size bigint, set array<bigint>"), "sets")
    repeated = sets.groupBy("node").count().where("count > 1").head(1)
    return sets.dropDuplicates(["node"]) if repeated else sets


def _rarest(rows: DataFrame, keep) -> DataFrame:
    """Per node, the elements that other nodes have too, rarest first, cut by ``keep(size, shared)``; nodes left without any go."""
    counted = rows.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("df > 1")
    lists = counted.groupBy("node").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    count = keep(F.col("size"), F.size("shared"))
    return (lists.withColumn("n", count.cast("int")).where("n > 0")
            .select("node", "size", F.size("shared").alias("common"), F.transform(F.slice("shared", F.lit(1), F.greatest("n", F.lit(0))), lambda x: x["token"]).alias("tokens")))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("right"))
    overlap = F.size(F.array_intersect("left", "right"))
    both = pairs.join(left, "a").join(right, "b").withColumn("o", overlap)
    return both.where(100 * F.col("o") >= percent * (F.size("left") + F.size("right") - F.col("o"))).select("a", "b")


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def links(docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """Verified edges (a, b) between classes that connect every two linked classes."""
    least_overlap = lambda size: F.ceil(size * percent / 100.0 - 1e-9)
    rows = classes.select("node", "size", F.explode("prefix").alias("token"))
    level = lambda size: 1 + F.floor(least_overlap(size) / LEVEL_STEP)  # noqa: E731  of the smallest partner
    alive = materialize(_rarest(rows, lambda size, shared: shared - level(size) + 1), "alive")

    entries = (alive.select("node", "size", F.explode("tokens").alias("token"))
               .withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("members > 1"))
    entries = materialize(entries, "entries")
    fits = lambda p, q: (100 * F.least(p, q) >= percent * F.greatest(p, q))
    cheap = entries.where(F.col("members") <= CHEAP)
    other = cheap.select("token", F.col("node").alias("other"), F.col("size").alias("other_size"))
    near = (cheap.join(other, "token").where((F.col("node") < F.col("other")) & fits("size", "other_size"))
            .select(F.col("node").alias("a"), F.col("other").alias("b")).distinct())
    near = materialize(near, "near")
    dear = materialize(entries.where(F.col("members") > CHEAP).select("node").distinct(), "dear")

    needed = near.select(F.col("a").alias("node")).union(near.select("b")).union(dear).distinct()
    sets = class_sets(docs, materialize(classes.join(needed, "node").select("doc_id", "node", "digest"), "needed"), n)
    edges = materialize(verified(near, sets, percent), "edges")

    whole = sets.join(dear, "node").select("node", "size", F.explode("set").alias("token"))
    # unique elements come first: of the size - m + 1 rarest, size - shared are unique
    long_lists = _rarest(whole, lambda size, shared: shared - least_overlap(size) + 1)
    members = materialize(long_lists.select("node", "size", "common", F.posexplode("tokens").alias("at", "token"))
                          .withColumn("after", F.col("common") - F.col("at")), "members")  # elements from this one on
    # the first common element of two sets has all others behind it: o is at most what either has from there on
    can = lambda p, q, c, d: ((100 + percent) * F.least(c, d) >= percent * (p + q)) & fits(p, q)
    centre = (members.groupBy("token").agg(F.min(F.struct((1 - F.col("common") / F.col("size")).alias("own"), "node", "size", "after")).alias("c"))
              .select("token", F.col("c.node").alias("hub"), F.col("c.size").alias("hub_size"), F.col("c.after").alias("hub_after")))
    star = (members.join(centre, "token").where((F.col("node") != F.col("hub")) & can(F.col("size"), F.col("hub_size"), F.col("after"), F.col("hub_after")))
            .select(*_ordered("node", "hub")).distinct())
    edges = materialize(edges.union(verified(star, sets, percent)), "edges")

    labels = components(edges)
    placed = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = placed.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
    open_ = materialize(placed.join(mixed, "token"), "open")
    other = open_.select("token", *[F.col(c).alias(f"{c}_b") for c in ("node", "size", "after", "label")])
    rest = (open_.join(other, "token").where((F.col("node") < F.col("node_b")) & (F.col("label") != F.col("label_b"))
                                             & can(F.col("size"), F.col("size_b"), F.col("after"), F.col("after_b")))
            .select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct())
    return materialize(edges.union(verified(rest, sets, percent)), "edges")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the smallest id reachable by links of at least ``percent`` per cent.

    Words are runs of characters other than ASCII white space, A-Z lower-cased.  Texts with fewer than n words are one shingle; null texts
    and texts without words have an empty set, are linked with nothing and keep their own id.  Repeated rows are one class; null
    ids are never the smallest while another id is reachable.  An empty table gives an empty result; further columns are ignored.
    """
    docs = chosen(docs, doc_id=id_col, text=text_col)
    prefixes = materialize(class_prefixes(docs, n, percent), "prefixes")
    classes = classes_of(prefixes)
    labels = components(links(docs, classes, n, percent))
    roots = classes.select("node", "digest", F.col("doc_id").alias("root"))
    named = labels.join(roots, "node")
    found = named.join(named.groupBy("label").agg(F.min("root").alias("component_id")), "label").select("node", "component_id")
    all_ = roots.join(found, "node", "left").select("digest", F.coalesce("component_id", "root").alias("component_id"))
    return (prefixes.select("doc_id", "digest", "size").join(all_, "digest", "left")
            .select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))
