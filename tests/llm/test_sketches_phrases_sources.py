"""Sketch dedup, collocations and source divergence against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from claimloom.llm import collocations, divergence, jaccard_join, shingles, sketch_dedup, token_shards, top_k
from odd import ODD, odd_documents
from test_copies_and_search import brute_components, near_copies

THUE_MORSE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
COMPLEMENT = THUE_MORSE.translate(str.maketrans("ab", "ba"))


def found_copies(df, **how):
    return Counter(tuple(r) for r in sketch_dedup.near_copies(df, **how).collect())


def kept_too(components):
    return Counter({(doc, n, least, doc == least): times for (doc, n, least), times in components.items()})


@pytest.mark.parametrize("seed,n,percent,k", [(1, 4, 80, 128), (3, 5, 80, 64), (4, 4, 90, 128)])
def test_near_copies_against_all_pairs(spark, seed, n, percent, k):
    docs = near_copies(seed)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert found_copies(df, n=n, percent=percent, k=k) == kept_too(brute_components(docs, n, percent))


def test_near_copies_of_odd_documents(spark):
    docs = [(i, t) for i, t, _ in ODD]
    assert found_copies(odd_documents(spark)) == kept_too(brute_components(docs, 4, 80))
    assert sketch_dedup.near_copies(odd_documents(spark, [])).count() == 0


def test_lists_of_unlinked_members_meet_in_tiles(spark, monkeypatch):
    """Texts that share three quarters of their shingles with all others, and some chains of links between them."""
    monkeypatch.setattr(sketch_dedup, "TILE", 7)
    rng = random.Random(5)
    shared = [f"s{i}" for i in range(75)]
    docs = [(i, " ".join(shared + [f"w{i}x{j}" for j in range(12)])) for i in range(60)]
    docs += [(100 + i, " ".join(shared + [f"w{i}x{j}" for j in range(rng.randint(8, 11))])) for i in range(0, 60, 3)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert found_copies(df, percent=90) == kept_too(brute_components(docs, 4, 90))


def test_least_retained_keeps_the_tail_small():
    rng = np.random.default_rng(1)
    for k in (64, 128, 256):
        least = sketch_dedup.least_retained(k, 80)
        assert 0.2 * k < least < 0.65 * k
        assert rng.binomial(k, 0.8, 100_000).min() >= least
    assert sketch_dedup.least_retained(128, 100) == 128


def test_long_words_of_two_letters_have_hashes_of_their_own(spark):
    one, two, both = shingles.words_of([THUE_MORSE, COMPLEMENT, f"x {THUE_MORSE}\n{COMPLEMENT} y"])
    assert one[0] != two[0] and both[1] == one[0] and both[2] == two[0]
    for length in (4, 8, 16, 64, 128, 2048):
        x = (THUE_MORSE * 2)[:length]
        a, b = shingles.words_of([x, x.translate(str.maketrans("ab", "ba"))])
        assert a[0] != b[0]
    docs = spark.createDataFrame([(1, THUE_MORSE), (2, COMPLEMENT), (3, COMPLEMENT)], "doc_id bigint, text string")
    expected = {(1, 1, 1), (2, 1, 2), (3, 1, 2)}
    assert {tuple(r) for r in jaccard_join.jaccard_components(docs).collect()} == expected
    assert {tuple(r)[:3] for r in sketch_dedup.near_copies(docs).collect()} == expected


def test_word_hashes_tell_all_words_apart():
    rng = random.Random(2)
    words = list({"".join(rng.choice("abé中") for _ in range(rng.randint(1, 40))) for _ in range(20_000)})
    (hashes,) = shingles.words_of([" ".join(words)])
    assert len(hashes) == len(words) == len(set(hashes.tolist()))


def test_repeated_query_rows_are_one_query(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)]
    good = top_k.integer_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    once = top_k.top_k(good, good.where("vec_id % 100 = 0"), 10).collect()
    twice = top_k.top_k(good, good.where("vec_id % 100 = 0").union(good.where("vec_id = 0")), 10).collect()
    assert sorted(once) == sorted(twice) and len(twice) == 20


def brute_collocations(docs, least, percent, first):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").encode().lower().decode()):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for i in range(len(words)):
                for j in range(i + 1, min(i + 4, len(words)) + 1):
                    f[lang][tuple(words[i:j])] += 1
    out = set()
    for lang, counts in f.items():
        wanted = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in wanted.items():
            inside = any(len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) and 100 * b >= percent * a for q, b in wanted.items())
            score, _, x, y = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), x, y))
        out |= {(lang, i, phrase.decode(), -a, x, y, n[lang], -score) for i, (score, a, phrase, x, y) in enumerate(sorted(rows)[:first], 1)}
    return out


def phrase_documents(seed):
    rng = random.Random(seed)
    words = ["Ab", "b", "c", "dé", "é", "x-1", "Z", "中", "q\x00"]
    return [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", " c b "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "de", None]))
            for i in range(150)]


@pytest.mark.parametrize("most_words", [collocations.DICTIONARY_WORDS, 3])
def test_collocations_against_all_phrases(spark, most_words):
    docs = phrase_documents(1) + ODD
    df = odd_documents(spark, docs).repartition(3)
    rows = collocations.collocations(df, least=12, first=150, most_words=most_words).collect()
    assert {tuple(r) for r in rows} == brute_collocations(docs, 12, 80, 150)
    assert len({r["lang"] for r in rows}) == 3
    assert collocations.collocations(odd_documents(spark, []), most_words=most_words).count() == 0


def test_windows_of_both_ways_are_equal(spark):
    docs = odd_documents(spark, phrase_documents(2)).select("lang", "text")
    words = collocations.dictionary(collocations.word_counts(docs), 20)
    assert sorted(r[0] for r in words.select("number").collect()) == list(range(1, words.count() + 1))
    total = lambda most: {tuple(r) for r in collocations.windows(docs, words, most).groupBy("pair", "rest").sum("n").collect()}
    assert total(1) == total(10_000)


def test_only_longest_windows_are_counted(spark):
    """One window per word, however many phrases begin with it: the shorter ones come from the rollup."""
    docs = spark.createDataFrame([("en", "a b c d e f g")] * 5, "lang string, text string")
    words = collocations.dictionary(collocations.word_counts(docs), 1)
    counted = collocations.windows(docs, words)
    assert counted.agg({"n": "sum"}).first()[0] == 5 * 7
    phrases = collocations.phrase_counts(counted, 5)
    assert Counter(r["length"] for r in phrases.collect()) == {1: 7, 2: 6, 3: 5, 4: 4}


def brute_audit(docs, least, ranks):
    docs = [(t or "", la or "", s or "") for t, la, s in docs]
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.encode().lower().decode())
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, d in held[lang].items() if d >= least)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10 ** 9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        own = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum((own[s][t] - own[o][t]) ** 2 // own[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (own[s][t] - whole[t]) ** 2 // whole[t]) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, rows, most in (("pair", pairs, None), ("term", terms, ranks)):
                ranked = sorted(rows, key=lambda r: (-r[1], r[0].encode()))[:most]
                out |= {(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)}
    return out


@pytest.mark.parametrize("block,tile,front", [(1024, 32, 1 << 21), (8, 3, 1 << 21), (64, 32, 64)])
def test_audit_against_all_terms(spark, monkeypatch, block, tile, front):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "FRONT", front)
    rng = random.Random(6)
    vocabulary = [f"{a}{b}" for a in "abcdeé中" for b in ("", "X", "ys", "zé", "-", "7q")]
    text = lambda: " ".join(rng.choice(vocabulary[: rng.choice([5, 20, 42])]) for _ in range(rng.randint(0, 50)))
    docs = [(text(), rng.choice(["en", "en", "de"]), rng.choice([None, "", "s1", "s2", "s3", "é", "s4", "s5"])) for _ in range(120)]
    docs += [("12 34 !!", "xx", "only"), (None, "xx", "none"), ("lone words here", "yy", "a"), (None, "en", "silent"), (None, None, None)]
    df = spark.createDataFrame([(*d, 1, 1) for d in docs], "text string, lang string, source string, n int, term int")
    rows = divergence.audit(df.repartition(3), ranks=7).collect()
    assert {tuple(r) for r in rows} == brute_audit(docs, 3, 7) and len(rows) == len(set(rows))
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_of_very_large_counts(spark):
    row = spark.range(1).selectExpr("1000000000000000L as n", "3000000000000000L as total", "7L as v").select(divergence.share("n", "total").alias("p")).first()
    assert row["p"] == 1 + 10 ** 9 * (10 ** 15 + 1) // (3 * 10 ** 15 + 7)


def test_equal_subtrees_are_one_node():
    """Groups with the same counts in the same or in other places share nodes, and equal node pairs are one entry of the front."""
    import pandas as pd
    rows = pd.DataFrame([(s, p, n) for s in "ab" for p, n in ((0, 5), (1, 2), (4, 5), (5, 2), (6, 1))] + [("c", 0, 5)], columns=["source", "place", "n"])
    roots, tree = divergence._subtrees(rows, pd.Index(list("abc")))
    assert roots[0] == roots[1] != roots[2]
    assert [len(level[0]) for level in tree[1:]] == [4, 4, 3]  # with the empty node: (5,2) (1,0) (5,0); two halves of a and b and one of c; two roots
    pair, n, m, times = divergence._count_pairs(roots, tree, np.array([0, 0]), np.array([1, 2]))
    assert sorted(zip(pair.tolist(), n.tolist(), m.tolist(), times.tolist())) == [(0, 1, 1, 1), (0, 2, 2, 2), (0, 5, 5, 2), (1, 5, 5, 1)]


def test_shards_beyond_five_digits_stay_in_order(spark, tmp_path):
    for number, value in ((99_999, 1), (100_000, 2)):
        ids = np.array([value, token_shards.END_ID] + [token_shards.FILL] * (token_shards.RECORD_IDS - 2), "<u2")
        (tmp_path / f"part-{number:05d}-x.txt").write_bytes(ids.tobytes() + b"\n")
    rows = token_shards.read_records(spark, str(tmp_path)).orderBy("record").collect()
    assert [int(np.frombuffer(bytes(r["ids"]), "<u2")[0]) for r in rows] == [1, 2]
    assert sorted((r["slot"], r["shard"]) for r in token_shards.shard_documents(spark, str(tmp_path)).collect()) == [(0, 99_999), (1, 100_000)]
