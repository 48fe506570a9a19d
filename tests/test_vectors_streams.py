import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from claimloom.operators import normalize, pairs, similar, tables, vector_index, verdicts
from claimloom.plans import catalog, catalog_streams, catalog_vectors
from claimloom.session import materialize
from claimloom.sources import derived
from claimloom.streaming import increments


def vectors(spark, n=120, hot=0.7, seed=5):
    """Most claims sit in one document."""
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, 8)).astype("float32")
    data[3] = data[4]
    rows = [("hot" if i < hot * n else f"d{i % 5}", "ns" if i % 11 else "other", f"c{i:04d}", [float(x) for x in data[i]]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "document_id string, namespace string, claim_id string, vector array<float>")


def brute(rows, k, threshold):
    found = []
    for d, ns, a, va in rows:
        near = []
        for d2, ns2, b, vb in rows:
            if d2 == d and ns2 == ns and a != b:
                s = np.dot(va, vb) / np.linalg.norm(va) / np.linalg.norm(vb)
                if round(s, 9) >= threshold:
                    near.append((-round(s, 9), b))
        found += [(a, b) for _, b in sorted(near)[:k]]
    return sorted(found)


def test_neighbours_equal_brute_force_for_any_tile_size(spark):
    rows, df = vectors(spark)
    want = brute(rows, 3, 0.2)
    for tile in (7, 1000):
        got = similar.top_neighbours(df, k=3, threshold=0.2, tile_rows=tile)
        assert sorted((r.claim_id, r.neighbour_id) for r in got.collect()) == want


def grouped_vectors(spark, n=1200, groups=40):
    """Vectors around some centres, most of them in one document; a few nulls."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(groups, 16))
    rows = [("hot" if i % 5 else f"d{i % 3}", "ns", f"c{i:05d}", [float(x) for x in centres[i % groups] + 0.25 * rng.normal(size=16)] if i % 97 else None) for i in range(n)]
    return spark.createDataFrame(rows, "document_id string, namespace string, claim_id string, vector array<float>")


def test_index_finds_most_with_few_comparisons(spark):
    """Where vectors form groups; lists longer than a tile are split; similarities are those of the exact search."""
    df = grouped_vectors(spark)
    exact = similar.top_neighbours(df, k=5, threshold=0.5)
    found = vector_index.index_neighbours(df, k=5, threshold=0.5, tile_rows=16)
    rows = {r.document_id: r for r in vector_index.measured(df, found, exact).collect()}
    hot = rows["hot"]
    assert hot.neighbours > 4000 and hot.recall >= 0.9 and hot.comparisons < 0.25 * hot.exact_comparisons
    wanted = {(r.claim_id, r.neighbour_id): r.similarity for r in similar.top_neighbours(df, k=1000, threshold=0.5).collect()}
    near = found.neighbours.collect()
    assert all(abs(wanted[r.claim_id, r.neighbour_id] - r.similarity) < 1e-9 for r in near) and len({(r.claim_id, r["rank"]) for r in near}) == len(near)


def test_index_that_looks_everywhere_is_exact(spark):
    rows, df = vectors(spark)
    key = ["document_id", "claim_id", "neighbour_id", "rank"]
    found = vector_index.index_neighbours(df, k=5, threshold=0.2, recall=1.0, tile_rows=8)
    assert sorted(found.neighbours.select(*key).collect()) == sorted(similar.top_neighbours(df, k=5, threshold=0.2).select(*key).collect())
    assert all(r.comparisons == r.exact_comparisons and r.recall == 1 for r in vector_index.measured(df, found, similar.top_neighbours(df, k=5, threshold=0.2)).collect())
    empty = vector_index.index_neighbours(df.limit(0))
    assert empty.neighbours.count() == 0 and empty.comparisons.count() == 0


def test_each_text_is_embedded_once(spark):
    texts = spark.createDataFrame([(i, f"t{i % 3}") for i in range(9)], "id int, embedding_text string").withColumn(
        "embedding_text_hash", similar.text_hash(F.col("embedding_text")))
    cache = texts.where("embedding_text = 't0'").select(F.lit("n").alias("namespace"), "embedding_text_hash", F.array(F.lit(9.0).cast("float")).alias("vector")).distinct()
    found, created = similar.embed_once(texts, cache, "n", lambda df: df.withColumn("vector", F.array(F.lit(1.0).cast("float"))))
    assert created.count() == 2
    assert sorted((r.embedding_text, r.vector[0]) for r in found.collect()) == [("t0", 9.0)] * 3 + [("t1", 1.0)] * 3 + [("t2", 1.0)] * 3


def test_vector_audit(spark):
    cases = [([1.0, 2.0], None), ([1.0], "wrong_dimension"), (None, "wrong_dimension"), ([0.0, 0.0], "zero_vector"),
             ([float("nan"), 1.0], "not_finite_float32"), ([float("inf"), 1.0], "not_finite_float32"), ([None, 1.0], "not_finite_float32")]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v array<double>")
    got = {r.i: r.p for r in df.select("i", similar.vector_problem(F.col("v"), 2).alias("p")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_hashed_embeddings_of_claims(spark, sf):
    row = catalog_vectors.hashed_vectors(spark, sf).agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("d")).first()
    assert (row.n, row.d) == (1500, 256)


def test_snapshots_replace_and_survive_partial_writes(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    table = tables.Snapshot(spark, str(tmp_path / "t"), df.schema)
    assert table.read().count() == 0
    table.replace(df)
    table.replace(tables.upsert(table.read(), spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int"), ["k"]))
    assert sorted(table.read().collect()) == [("a", 1), ("b", 2), ("c", 2)]
    broken = tmp_path / "t" / "v7"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half")
    assert sorted(table.read().collect()) == [("a", 1), ("b", 2), ("c", 2)]


def test_insert_once_keeps_stored_and_last(spark):
    stored = spark.createDataFrame([("k", "old", 0)], "k string, v string, n int")
    batch = spark.createDataFrame([("k", "new", 1), ("m", "first", 1), ("m", "last", 2)], "k string, v string, n int")
    assert sorted((r.k, r.v) for r in tables.insert_once(stored, batch, ["k"], "n").collect()) == [("m", "last")]


def test_pool_equals_batch_after_restart_and_replay(spark, sf, tmp_path):
    """Files arrive in two waves, the stream restarts between them, and a finished batch is delivered again."""
    claims = derived.order_claims(spark, sf)
    whole = catalog.judged_pairs(spark, sf)
    job = increments.ClaimPool(spark, str(tmp_path), catalog.claims_n(spark, sf).schema, whole.schema, tile_rows=8)
    incoming, seen = str(tmp_path / "in"), []

    def step(batch, batch_id):
        seen.append(batch_id)
        job.step(batch, batch_id)

    for part in ("source_page <= 4", "source_page > 4"):
        claims.where(part).coalesce(1).write.mode("append").parquet(incoming)
        increments.run_available(increments.file_stream(spark, incoming, claims.schema), step, str(tmp_path / "cp"))
    assert seen == [0, 1]
    job.step(claims.where("source_page > 4"), 1)
    key = ["document_id", "claim_a_id", "claim_b_id", "classification", "score"]
    stored = job.verdicts.read().select(*key)
    expected = whole.select(*key)
    assert stored.count() == expected.count() and stored.exceptAll(expected).count() == 0


def test_new_and_stored_vectors_give_the_lists_of_one_search(spark):
    """Batches of any order: the best of the stored lists and of the new matches are the best of all; stored vectors meet new ones only."""
    rng = random.Random(8)
    rows = [(rng.choice(["d1", "d1", "d2"]), "n", f"c{i:03}", [rng.choice([0.0, 1.0, 2.0, -1.0]) for _ in range(4)] if i % 17 else None) for i in range(150)]
    rows = [r for r in rows if r[3] is None or any(r[3])]
    schema = "document_id string, namespace string, claim_id string, vector array<double>"
    how = {"k": 4, "threshold": 0.1, "tile_rows": 8}
    found = lambda lists: sorted((r.claim_id, r.neighbour_id, r["rank"]) for r in lists.collect())
    wanted = found(similar.top_neighbours(spark.createDataFrame(rows, schema), **how))
    rng.shuffle(rows)
    stored, lists = spark.createDataFrame([], schema), None
    for part in (rows[:60], rows[60:61], rows[61:]):
        new = spark.createDataFrame(part, schema)
        across = similar.matches_across(new, stored, **how)
        ids = {r[2] for r in part}
        assert all((r.claim_id in ids) != (r.neighbour_id in ids) for r in across.collect())
        matches = similar.matches_within(new, **how).unionByName(across)
        lists = materialize(similar.best_matches(matches if lists is None else matches.unionByName(lists.drop("rank")), 4), "lists")
        stored = stored.unionByName(new)
    assert found(lists) == wanted


def test_semantic_pool_equals_batch_after_replay(spark, sf, tmp_path):
    claims = materialize(derived.order_claims(spark, sf).where("claim_id < 'c0000000500'"), "some_claims")
    pool = catalog_streams.semantic_pool(spark, sf, str(tmp_path), tile_rows=4)
    parts = [claims.where(F.pmod(F.xxhash64("claim_id"), F.lit(3)) == i) for i in range(3)]
    for batch_id in (0, 1, 1, 2):
        pool.step(parts[batch_id], batch_id)
    stored = normalize.accepted(normalize.normalize_claims(claims))
    sides = materialize(pairs.sides(stored), "sides")
    lists = similar.top_neighbours(catalog_streams.given_vectors(spark, sf)(stored), k=3, threshold=0.0)
    key = ["document_id", "claim_id", "neighbour_id", "rank"]
    assert sorted(pool.neighbours().select(*key).collect()) == sorted(lists.select(*key).collect()) and lists.count() > 20
    labelled = pairs.labelled(pairs.pairs_of(sides))
    merged = pairs.merge_pairs(labelled.select(*pairs.pair_ids(labelled), "preliminary_classification"), pairs.best_similarity(lists))
    judged = verdicts.judged(pairs.scored(pairs.pairs_by_key(merged, sides), F.col("similarity")))
    key = ["document_id", "claim_a_id", "claim_b_id", "classification", F.round("score", 9)]
    assert sorted(pool.all_verdicts().select(*key).collect()) == sorted(judged.select(*key).collect())


def test_entry_contract(spark):
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and entry.FLAGSHIP in names and len(names) > 150
    df = entry.entry(spark)
    assert df.columns[:3] == ["document_id", "claim_a_id", "claim_b_id"] and df.count() > 0
    assert isinstance(df.limit(3).toPandas(), pd.DataFrame)


def test_one_micro_batch_takes_all_files_of_a_delivery(spark, tmp_path):
    path, met = str(tmp_path / "incoming"), []
    for _ in range(2):
        rows = spark.range(0, 90, 1, 3)
        rows.write.mode("append").parquet(path)
        increments.run_available(increments.file_stream(spark, path, rows.schema, catalog_streams.ALL_FILES),
                                 lambda batch, n: met.append((n, batch.count())), str(tmp_path / "checkpoint"))
    assert met == [(0, 90), (1, 90)]


def test_micro_batches_of_several_files(spark, sf, tmp_path):
    """A micro-batch has files for every core, and the number of micro-batches stays what was asked for."""
    claims, cores = derived.order_claims(spark, sf), spark.sparkContext.defaultParallelism
    path, files = catalog_streams.deliveries(claims, str(tmp_path), "claim_id", batches=2)
    assert files >= cores and len(list((tmp_path / "incoming").glob("*.parquet"))) == 2 * files
    assert spark.read.parquet(path).count() == claims.count()


def test_small_tiles_are_sent_in_strips(spark):
    """Vectors were sent once for every tile of their document: n * n / tile rows. They are sent once for every strip, and multiplied in the same tiles."""
    rows, df = vectors(spark)
    want = brute(rows, 3, 0.2)
    for strip in (1, 14, 10_000):  # one tile, a few and all to a strip
        got = similar.top_neighbours(df, k=3, threshold=0.2, tile_rows=7, strip_rows=strip)
        assert sorted((r.claim_id, r.neighbour_id) for r in got.collect()) == want
    many = spark.range(1_000).select(F.lit("d").alias("document_id"), F.lit("n").alias("namespace"), F.col("id").cast("string").alias("claim_id"),
                                     F.array(F.cos("id"), F.sin("id")).cast("array<float>").alias("vector"))
    sizes = []
    cells = similar._cells  # gives the rows that are sent
    try:
        similar._cells = lambda *a: sizes.append((made := cells(*a)).count()) or made
        similar.matches_within(many, k=3, threshold=0.2, tile_rows=10)
    finally:
        similar._cells = cells
    assert sizes == [1_000]
