"""MinHash near-dedup by bottom-k sketches from one hash function.

A text's shingles are hashed once, by one function; the ``SKETCH`` smallest values of its set are its sketch, so the smallest values of two
sketches together are the sketch of the union of both sets, and each of them lies in both sets with the similarity as its chance.
Documents with the same words in the same order are one class; the join runs over classes.

1. Inverted lists of retained values.  Two sets that reach the similarity share at least ``least_shared`` retained values: exactly so for
   sets whose partners' unions fit a sketch, else but for a chance below ``MISS`` (a tail bound of the hypergeometric distribution).  A
   class therefore stands only in the lists of its rarest values, all but the last least_shared - 1; values that no other class retains
   come first and have no list.
2. Every list links its members to one hub.  What the lists say of a pair - how many retained values both have from this one on - rules out most
   pairs; the union sketch estimates the others, and pairs below ``least_shared`` go.
3. Pairs that are left are verified on the full sets (a sketch that holds its whole set is the full set).
4. Members of lists that do not lie in one component yet get sketches ``LONGER`` times as long, whose estimate is sharper and which hold most sets
   whole, and lists of their own.  Those give the remaining pairs of members of different components, long lists in tiles, to the
   same estimate and verification.  No pair inside a component is formed, so a group of thousands of copies costs one pair per member.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import chosen, texts_of
from claimloom.llm.components import components
from claimloom.llm.shingles import sequence_digest, shingle_set, words_of
from claimloom.session import materialize

SHINGLE, PERCENT = 4, 80
SKETCH = 128
LONGER = 8
MISS = 1e-18
TILE = 2048
BROADCAST_CLASSES = 1_000_000  # 40 bytes each


def least_retained(k: int, percent: int) -> int:
    """The least number of values of a union sketch of size k that two sets of this similarity share, but for a chance below MISS.

    Chernoff's bound for binomial tails holds for the hypergeometric distribution, too.
    """
    p = percent / 100
    if p >= 1:
        return k
    fits = 0
    for t in range(1, int(k * p)):
        x = (t - 1) / k  # fewer than t are shared
        divergence = (x * math.log(x / p) if x else 0) + (1 - x) * math.log((1 - x) / (1 - p))
        if math.exp(-k * divergence) <= MISS:
            fits = t
    return max(fits, 1)


def least_shared(size: Column, k: int, percent: int) -> Column:
    """Retained values that a set of ``size`` shares with any linked set; a linked set of one below percent * k forms a union within k."""
    return F.when(100 * size <= percent * k, F.ceil(size * percent / 100 - 1e-9)).otherwise(least_retained(k, percent))


def _signed(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers as signed ones in the same order."""
    return (values ^ np.uint64(1 << 63)).view(np.int64)


def sketches(docs: DataFrame, n: int, k: int) -> DataFrame:
    """(doc_id, digest, size, sketch): class of each text, number of distinct shingles, and the k smallest of their hashes."""
    def work(batches):
        for batch in batches:
            digests, sizes, sketch = [], [], []
            for words in words_of(texts_of(batch.column(1))):
                found = shingle_set(words, n)
                digests.append(sequence_digest(words))
                sizes.append(len(found))
                sketch.append(_signed(found[:k]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketch, pa.list_(pa.int64()))],
                                             names=["doc_id", "digest", "size", "sketch"])

    return docs.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest binary, size bigint, sketch array<bigint>")


def inverted_lists(classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(token, node, size, after, members, hub, hub_size, hub_after): a row per retained value that a class may be found by.

    ``after`` counts the values of the class, from this one on in order of rarity, that any other class retains.  The hub of a list is its
    member with the fewest values of its own.
    """
    values = classes.select("node", "size", F.explode("sketch").alias("token"))
    frequency = values.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = (values.join(frequency, "token").groupBy("node").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
              .withColumn("kept", (F.size("shared") - least_shared(F.col("size"), k, percent) + 1).cast("int")).where("kept > 0"))
    entries = materialize(ranked.select("node", "size", F.size("shared").alias("common"), F.posexplode(F.slice("shared", F.lit(1), F.greatest("kept", F.lit(0)))).alias("at", "v"))
                          .select(F.col("v.token").alias("token"), "node", "size", (F.col("common") - F.col("at")).alias("after"),
                                  (1 - F.col("common") / F.least("size", F.lit(k))).alias("own")), "entries")
    lists = (entries.groupBy("token").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("own", "node", "size", "after")).alias("h")).where("members > 1")
             .select("token", "members", F.col("h.node").alias("hub"), F.col("h.size").alias("hub_size"), F.col("h.after").alias("hub_after")))
    return materialize(entries.join(lists, "token").drop("own"), "lists")


def estimated(pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, sure): the pairs whose union sketch allows the similarity; ``sure`` where both sketches are whole sets and reach it."""
    side = lambda node, name: classes.select(F.col("node").alias(node), F.col("size").alias(f"size_{node}"), F.col("sketch").alias(name))
    both = pairs.join(side("a", "left"), "a").join(side("b", "right"), "b")
    met = both.withColumn("union", F.sort_array(F.array_union("left", "right"))).withColumn("met", F.array_intersect("left", "right"))
    shared = F.size(F.array_intersect("met", F.slice("union", 1, k)))
    whole = (F.col("size_a") <= k) & (F.col("size_b") <= k)
    reached = 100 * F.size("met") >= percent * F.size("union")
    return met.where(F.when(whole, reached).otherwise(shared >= least_retained(k, percent))).select("a", "b", whole.alias("sure"))


def full_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, set) of the ``wanted`` (doc_id, node, digest), from their whole texts, stored; one row per node."""
    wanted = materialize(wanted, "wanted")
    named = docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_CLASSES else wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"]))

    def work(batches):
        for batch in batches:
            nodes, digests, texts = (c.to_pylist() for c in batch.columns)
            rows = [(node, _signed(shingle_set(words, n))) for node, digest, words in zip(nodes, digests, words_of([t or "" for t in texts]))
                    if sequence_digest(words) == digest]  # an id may name several texts
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["node", "set"])

    return materialize(named.select("node", "digest", "text").mapInArrow(work, "node bigint, set array<bigint>").dropDuplicates(["node"]), "sets")


def reaching(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the ``pairs`` whose full ``sets`` reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("right"))
    both = pairs.join(left, "a").join(right, "b").withColumn("o", F.size(F.array_intersect("left", "right")))
    return both.where(100 * F.col("o") >= percent * (F.size("left") + F.size("right") - F.col("o"))).select("a", "b")


def named(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    return classes.join(nodes, "node").select("doc_id", "node", "digest")


def _possible(k: int, percent: int, size: str, after: str, other_size: str, other_after: str) -> Column:
    """Whether two members of a list can be linked, by their sizes and by the values they retain from this one on."""
    p, q = F.col(size), F.col(other_size)
    most = F.least(after, other_after)
    whole = (100 + percent) * most >= percent * (p + q)
    enough = F.when((p <= k) & (q <= k), whole).otherwise(most >= F.greatest(least_shared(p, k, percent), least_shared(q, k, percent)))
    return enough & (100 * F.least(p, q) >= percent * F.greatest(p, q))


def star_pairs(lists: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): every member of a list with its hub, where they can be linked."""
    near = lists.where((F.col("node") != F.col("hub")) & _possible(k, percent, "size", "after", "hub_size", "hub_after"))
    return near.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def open_classes(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label) of the members, hubs excepted, of lists whose members are not all in one component; stored."""
    placed = (lists.where((F.col("members") > 2) & (F.col("node") != F.col("hub"))).select("token", "node").join(labels, "node", "left")
              .select("token", "node", F.coalesce("label", "node").alias("label")))
    placed = materialize(placed, "placed")
    mixed = placed.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
    return materialize(placed.join(mixed, "token").select("node", "label").distinct(), "open")


def cross_pairs(lists: DataFrame, labels: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): members of one list in different components, where they can be linked.

    In a list, the members outside its largest component meet all members, so a list that lies in one component but for a few members
    costs these few times its length.  Long lists meet in tiles.
    """
    tiles = F.ceil(F.col("members") / TILE).cast("int")
    placed = materialize(lists.join(labels, "node").select("token", "node", "size", "after", "label", tiles.alias("tiles"), F.pmod(F.xxhash64("node"), tiles).cast("int").alias("tile")), "placed")
    largest = (placed.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.max(F.struct("n", "label")).alias("m"), F.count(F.lit(1)).alias("labels"))
               .where("labels > 1").select("token", F.col("m.label").alias("largest")))
    dealt = placed.join(largest, "token")
    every_tile = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    left = dealt.where("label <> largest").withColumn("meets", every_tile)
    right = dealt.withColumn("first", every_tile).select("token", F.col("first").alias("tile"), F.col("tile").alias("meets"), *[F.col(c).alias(f"{c}_b") for c in ("node", "size", "after", "label")])
    once = (F.col("label_b") == F.col("largest")) | (F.col("node") < F.col("node_b"))
    pairs = left.join(right, ["token", "tile", "meets"]).where(once & (F.col("label") != F.col("label_b")) & _possible(k, percent, "size", "after", "size_b", "after_b"))
    return pairs.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()


def links(docs: DataFrame, classes: DataFrame, n: int, k: int, percent: int) -> DataFrame:
    """Verified edges (a, b) between classes that connect every two linked classes."""
    lists = inverted_lists(classes, k, percent)
    likely = materialize(estimated(star_pairs(lists, k, percent), classes, k, percent), "likely")
    unsure = likely.where(~F.col("sure")).select("a", "b")
    sets = full_sets(docs, named(unsure.select(F.col("a").alias("node")).union(unsure.select("b")).distinct(), classes), n)
    edges = materialize(likely.where("sure").select("a", "b").union(reaching(unsure, sets, percent)), "edges")

    labels = open_classes(lists, components(edges))
    if not labels.head(1):
        return edges
    sets = full_sets(docs, named(labels.select("node"), classes), n)
    longer = sets.select("node", F.size("set").cast("bigint").alias("size"), F.slice("set", 1, LONGER * k).alias("sketch"))
    lists = inverted_lists(longer, LONGER * k, percent)
    likely = materialize(estimated(cross_pairs(lists, labels, LONGER * k, percent), longer, LONGER * k, percent), "likely")
    more = likely.where("sure").select("a", "b").union(reaching(likely.where(~F.col("sure")).select("a", "b"), sets, percent))
    return edges.union(materialize(more, "edges"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT, k: int = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: the smallest id reachable by links of at least ``percent`` per cent.

    Words are runs of characters other than ASCII white space, A-Z lower-cased.  Texts with fewer than n words are one shingle; null texts
    and texts without words have an empty set, are linked with nothing and keep their own id.  Repeated rows are one class; rows that
    repeat the smallest id are all kept.  Null ids are never the smallest while another id is reachable.  An empty table gives
    an empty result; further columns are ignored.
    """
    docs = chosen(docs, doc_id=id_col, text=text_col)
    told = materialize(sketches(docs, n, k), "sketches")
    classes = materialize(told.where("size > 0").groupBy("digest").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("doc_id"))
                          .withColumn("node", F.monotonically_increasing_id()), "classes")
    roots = classes.select("node", "digest", "doc_id")
    labelled = components(links(docs, classes, n, k, percent)).join(roots, "node")
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = labelled.join(least, "label").select("digest", "component_id")
    all_ = roots.join(found, "digest", "left").select("digest", F.coalesce("component_id", "doc_id").alias("component_id"))
    of_row = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return (told.select("doc_id", "digest", "size").join(all_, "digest", "left")
            .select("doc_id", F.col("size").alias("n_shingles"), of_row.alias("component_id"), F.col("doc_id").eqNullSafe(of_row).alias("kept")))
