import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from claimloom.llm import exact_copies, jaccard_join, queries, top_k
from claimloom.llm.components import components
from odd import ODD, odd_documents


def _set(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute_components(docs, n, percent):
    sets = [_set(t, n) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return Counter((doc, len(sets[i]), least.get(root(i))) for i, (doc, _) in enumerate(docs))


def found_components(df, n, percent):
    return Counter(tuple(r) for r in jaccard_join.jaccard_components(df, n=n, percent=percent).collect())


def near_copies(seed, groups=6, copies=25):
    """Groups of edited copies around a text, so that buckets are dear, and texts that share a passage only."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    passage, docs = [word() for _ in range(30)], []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([4, 12, 60, 150]))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 8])):
                at = rng.randrange(len(text))
                rng.choice([lambda: text.__setitem__(at, word()), lambda: text.insert(at, word()), lambda: len(text) > 1 and text.pop(at)])()
            docs.append(" ".join(text))
    docs += [" ".join([word() for _ in range(40)] + passage + [word() for _ in range(40)]) for _ in range(copies)]
    return [(i, t) for i, t in enumerate(rng.sample(docs, len(docs)))]


@pytest.mark.parametrize("seed,n,percent", [(1, 4, 85), (2, 5, 80)])
def test_jaccard_components_against_all_pairs(spark, seed, n, percent):
    docs = near_copies(seed)
    assert found_components(spark.createDataFrame(docs, "doc_id bigint, text string"), n, percent) == brute_components(docs, n, percent)


def test_jaccard_components_of_odd_documents(spark):
    docs = [(i, t) for i, t, _ in ODD]
    assert found_components(odd_documents(spark), 4, 85) == brute_components(docs, 4, 85)
    assert jaccard_join.jaccard_components(odd_documents(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {x: root(x) for x in list(parent)}


def test_exact_copies_of_odd_documents(spark):
    rows = exact_copies.exact_copies(odd_documents(spark).repartition(5)).collect()
    groups = {}
    for doc, text, _ in ODD:
        groups.setdefault((text or "").encode().lower(), []).append(doc)
    expected = Counter()
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        expected.update((i, best, len(ids), i == best, hashlib.sha256(text).hexdigest()) for i in ids)
    assert Counter(map(tuple, rows)) == expected
    smallest = {r["keep_id"] for r in exact_copies.exact_copies(odd_documents(spark), keep="min").where("text_sha256 = sha2('same text as the other', 256)").collect()}
    assert smallest == {5}
    assert exact_copies.exact_copies(odd_documents(spark, [])).count() == 0


def test_merge_rounds_over_many_runs(spark):
    runs = spark.range(2000).selectExpr("cast(id % 700 as int) as run", "sha(cast(id % 13 as string)) as d", "id")
    runs = runs.selectExpr("run", "cast(d as binary) as digest", "1L as size", "2L as check", "id as keep_id", "1L as group_size")
    rows = exact_copies.merged_runs(runs, 699).collect()
    assert sorted((r["keep_id"], r["group_size"]) for r in rows) == sorted((max(range(i, 2000, 13)), len(range(i, 2000, 13))) for i in range(13))


def brute_top_k(vectors, k):
    import math
    fine = {i: [math.floor(1024 * x) for x in v] for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in fine:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(fine[q], v)), i) for i, v in fine.items() if i != q)[:k]
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_against_all_products(spark, seed):
    rng = random.Random(seed)
    vectors = [(i, [rng.choice([-0.5, 0.25, float(np.float32(rng.gauss(0, 0.3)))]) for _ in range(rng.choice([6, 6, 6, 3]))]) for i in range(450)]
    vectors += [(500 + i, [0.5] * 6) for i in range(60)]  # many ties
    vectors += [(600, None), (700, [float("nan")] * 6), (701, [None] * 6), (702, [float("inf")] * 6), (703, []), (800, [1e6] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id bigint, embedding array<float>, score int")
    good = top_k.integer_vectors(df)
    rows = top_k.top_k(good, good.where("vec_id % 100 = 0"), 10, query_block=3, candidate_block=50).collect()
    assert {tuple(r) for r in rows} == brute_top_k(vectors, 10) and len(rows) == 70
    empty = good.limit(0)
    assert top_k.top_k(empty, empty).count() == 0
    few = good.where("vec_id < 5 or vec_id = 100")
    assert top_k.top_k(few, few.where("vec_id % 100 = 0"), 10).count() == 10


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels", "conversations"):
        db.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    check = db.execute(queries.CHECKS[name])
    columns = [c[0] for c in check.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(check.fetchall())
