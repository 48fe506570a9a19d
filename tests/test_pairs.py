import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimloom.operators import normalize, pairs, serving, verdicts
from claimloom.plans import catalog, catalog_review
from claimloom.sources import derived, registry, responses

SCHEMA = ("document_id string, chunk_id string, claim_id string, entity_raw string, metric_raw string, value_text string, "
          "value_numeric decimal(24,8), unit string, period string, scope string, qualifier string, claim_text string, "
          "source_page int, confidence decimal(5,4)")


def claim(i, value=None, unit=None, period=None, scope=None, qualifier=None, text=None, entity="Acme", metric="revenue", doc="d", words=None):
    number = None if value is None else Decimal(value)
    return (doc, "k", f"c{i:04d}", entity, metric, words or str(value), number, unit, period, scope, qualifier, text or "t", 1, Decimal("0.6"))


def normalized(spark, rows):
    return normalize.accepted(normalize.normalize_claims(spark.createDataFrame(rows, SCHEMA)))


def classes(spark, cases):
    """One document per case, two claims each -> class or None when the pair is dropped."""
    rows = [claim(2 * i + side, doc=f"d{i:03d}", **kw) for i, pair in enumerate(cases) for side, kw in enumerate(pair)]
    df = pairs.labelled(pairs.candidate_pairs(normalized(spark, rows)))
    found = {r.document_id: r.preliminary_classification for r in df.select("document_id", "preliminary_classification").collect()}
    return [found.get(f"d{i:03d}") for i in range(len(cases))]


def test_pair_classes(spark):
    usd = dict(unit="USD", period="2025", scope="consolidated")
    cases = [
        ((dict(value=1, unit="INR crore"), dict(value=10, unit="INR million")), None),
        ((dict(value=10, unit="USD", period="2024"), dict(value=12, unit="USD", period="2025")), "temporal_difference"),
        ((dict(value=10, unit="USD", period="2025", scope="standalone"), dict(value=12, **usd)), "possible_scope_difference"),
        ((dict(value=10, qualifier="approximately", **usd), dict(value=12, qualifier="approximately", **usd)), "possible_qualifier_difference"),
        ((dict(value=10, qualifier="audited; consolidated", **usd), dict(value=12, qualifier="audited; consolidated", **usd)), "candidate_contradiction"),
        ((dict(value=10, **usd), dict(value=12, unit="INR", period="2025", scope="consolidated")), "possible_unit_difference"),
        ((dict(value=10, unit="USD", period="March 2025", scope="x"), dict(value=12, unit="USD", period="Year ended March 31, 2025", scope="x")), "possible_period_difference"),
        ((dict(value=10, unit="USD", period="FY25", scope="x"), dict(value=12, unit="USD", period="FY25", scope="x")), "insufficient_context"),
        ((dict(value=10, unit="USD", period="2025"), dict(value=12, unit="USD", period="2025")), "insufficient_context"),
        ((dict(words="a", period="2025", scope="x"), dict(words="b", period="2025", scope="x")), "insufficient_context"),
        ((dict(words="a", **usd), dict(words="b", **usd)), "possible_value_difference"),
        ((dict(words="Same  Text", **usd), dict(words="same text", **usd)), None),
        ((dict(value=5), dict(value=5)), None),
        ((dict(value=5, unit="Cr", scope="x", period="2025"), dict(value=6, unit="cr", scope="x", period="2025")), "candidate_contradiction"),
    ]
    assert classes(spark, [c for c, _ in cases]) == [want for _, want in cases]


def test_rule_verdicts(spark):
    cases = [
        ((dict(value=300), dict(value=350)), ("CONTRADICTION", 0.95)),
        ((dict(value=1, unit="INR crore"), dict(value=10, unit="USD million")), ("CONTRADICTION", 0.95)),
        ((dict(words="on time", text="launch is not delayed"), dict(words="late", text="launch is delayed")), ("CONTRADICTION", 0.90)),
        ((dict(words="a", text="plan approved"), dict(words="b", text="plan rejected")), ("CONTRADICTION", 0.90)),
        ((dict(words="a", text="one thing"), dict(words="b", text="another")), ("CONSISTENT", 0.90)),
        ((dict(words="a", text="didn't grow", period="2025"), dict(words="b", text="grew")), ("UNCERTAIN", 0.40)),
    ]
    rows = [claim(2 * i + s, doc=f"d{i}", **kw) for i, (pair, _) in enumerate(cases) for s, kw in enumerate(pair)]
    judged = verdicts.judged(pairs.candidate_pairs(normalized(spark, rows))).collect()
    found = {r.document_id: (r.classification, float(r.confidence)) for r in judged}
    assert found == {f"d{i}": want for i, (_, want) in enumerate(cases)}
    assert {r.classification: r.status for r in judged} == {
        "CONTRADICTION": "verified", "CONSISTENT": "dismissed", "UNCERTAIN": "contextual_difference"}


def test_other_subject_is_uncertain(spark):
    rows = [claim(1, value=3), claim(2, value=4, metric="profit")]
    keys = spark.createDataFrame([("d", "c0001", "c0002")], "document_id string, claim_a_id string, claim_b_id string")
    row = verdicts.judged(pairs.pairs_by_key(keys, pairs.sides(normalized(spark, rows)))).first()
    assert (row.classification, float(row.confidence), row.status) == ("UNCERTAIN", 0.4, "contextual_difference")


def test_scores_on_both_sides_of_the_threshold(spark):
    base = dict(unit="USD")
    rows = [claim(1, 1, doc="kept", **base), claim(2, 2, doc="kept", **base),
            claim(3, 1, doc="out", entity="document subject", period="2025", scope="x", **base),
            claim(4, 2, doc="out", entity="document subject", period="2025", scope="X ", **base),
            claim(5, 1, doc="zero", scope="x", **base), claim(6, 2, doc="zero", scope="y", **base)]
    found = {r.document_id: r.score for r in pairs.scored(pairs.candidate_pairs(normalized(spark, rows))).collect()}
    assert found["kept"] == 0.65 and found["out"] == 0.6499999999999999 and found["zero"] == 0.0
    assert [r.document_id for r in pairs.above_threshold(pairs.scored(pairs.candidate_pairs(normalized(spark, rows)))).collect()] == ["kept"]


def random_claims(n, seed=3):
    rng = random.Random(seed)
    return [claim(i, rng.randint(0, 3), unit=rng.choice([None, "USD", "usd mn", "Cr"]), period=rng.choice([None, "2024", "FY 2024", "2024-03"]),
                  scope=rng.choice([None, "consolidated"]), qualifier=rng.choice([None, "audited", "about"])) for i in range(n)]


def keys(df):
    return sorted((r.claim_a_id, r.claim_b_id) for r in df.select(*pairs.pair_ids(df)).collect())


def test_hot_block_tiles_give_the_same_pairs(spark):
    """One block holding every claim, cut into tiles of five, equals brute force over the agreement rule."""
    rows = random_claims(60)
    claims = normalized(spark, rows)
    whole, tiled = keys(pairs.candidate_pairs(claims)), keys(pairs.candidate_pairs(claims, tile_rows=5))
    scale = {"USD": 1, "usd mn": 10**6, "Cr": 1}
    unit = {"USD": "USD", "usd mn": "USD", "Cr": "Cr"}

    def agree(a, b):
        if a[7] is None or b[7] is None:
            return a[6] == b[6]
        return unit[a[7]] == unit[b[7]] and a[6] * scale[a[7]] == b[6] * scale[b[7]]

    brute = sorted((a[2], b[2]) for a, b in itertools.combinations(rows, 2) if not agree(a, b))
    assert whole == tiled == brute and len(set(tiled)) == len(tiled)


def test_batches_of_pairs_add_up(spark):
    claims = normalized(spark, random_claims(40))
    old, new = claims.where("claim_id < 'c0020'"), claims.where("claim_id >= 'c0020'")
    parts = keys(pairs.candidate_pairs(old)) + keys(pairs.candidate_pairs(new)) + keys(pairs.candidate_pairs_between(new, old, tile_rows=6))
    assert sorted(parts) == keys(pairs.candidate_pairs(claims))


def test_counts_without_pairs_equal_listed_pairs(spark):
    claims = normalized(spark, random_claims(80))
    listed = pairs.labelled(pairs.candidate_pairs(claims)).groupBy("preliminary_classification").count().collect()
    counted = pairs.candidate_counts(pairs.sides(claims), tile_rows=7).collect()
    assert {r.preliminary_classification: r["count"] for r in listed} == {r.preliminary_classification: r.pairs for r in counted}


def test_ranking_counts_positions_in_two_steps(spark):
    rows = [("d", 0.5 + (i % 3) / 10, f"{i * 7 % 50:04d}", f"z{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "document_id string, score double, claim_a_id string, claim_b_id string")
    got = {(r.claim_a_id, r.claim_b_id): r.position for r in pairs.ranked(df).collect()}
    want = {(a, b): n + 1 for n, (_, _, a, b) in enumerate(sorted(rows, key=lambda r: (-r[1], r[2], r[3])))}
    assert got == want


def test_repeated_records_are_dropped(spark):
    claims = normalized(spark, random_claims(10) * 2)
    assert keys(pairs.candidate_pairs(claims, dedupe=True)) == keys(pairs.candidate_pairs(normalized(spark, random_claims(10))))


def test_plans_have_no_cartesian_product(spark, sf):
    df = catalog.judged_pairs(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan
    orders = derived.table(spark, sf, "orders").where("o_orderkey > 10").select("o_orderkey")
    scan = orders._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,10)]" in scan and "ReadSchema: struct<o_orderkey:bigint>" in scan


def test_normalization_stays_in_the_jvm(spark, sf):
    plan = normalize.accepted(normalize.normalize_claims(derived.order_claims(spark, sf)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") <= 1  # the registry, made distinct


def test_answers(spark):
    """Pairs without evidence are settled whatever was answered; the others need one valid answer."""
    queue = spark.createDataFrame([("d", "p1", "x", None), ("d", "p2", "x", None), ("d", "p3", "x", None), ("d", "p4", "x", "no source"), ("d", "p5", "x", "no source")],
                                  "document_id string, claim_a_id string, claim_b_id string, insufficient_reason string")
    given = [("p1/x", "CONSISTENT", "fine", 0.7), ("p2/x", "CONSISTENT", "a", 0.7), ("p2/x", "CONSISTENT", "b", 0.7),
             ("p9/x", "CONSISTENT", "c", 0.5), ("p3/x", "CONSISTENT", "d", 1.5), ("p4/x", "CONSISTENT", "e", 0.9)]
    answers = spark.createDataFrame([("d", *g) for g in given], "document_id string, candidate_id string, classification string, explanation string, confidence double")
    intake = verdicts.take_answers(queue, answers)
    assert {r.claim_a_id: r.intake for r in intake.collect()} == {
        "p1": "VERIFIED", "p2": "VERIFICATION_FAILED", "p3": "VERIFICATION_FAILED", "p4": "VERIFIED", "p5": "VERIFIED"}
    assert sorted(r.item_id for r in verdicts.insufficient_errors(intake).collect()) == ["p4/x", "p5/x"]
    rules = queue.selectExpr("document_id", "claim_a_id", "claim_b_id", "'UNCERTAIN' as classification", "'?' as explanation", "0.4 as confidence", "'contextual_difference' as status", "'rules' as source")
    final = {r.claim_a_id: (r.classification, r.status, float(r.confidence)) for r in verdicts.merge_verdicts(rules, rules.limit(0), intake).collect()}
    assert final["p4"] == final["p5"] == ("INSUFFICIENT_CONTEXT", "needs_review", 0.0)
    assert final["p1"][:2] == ("CONSISTENT", "dismissed") and final["p2"][0] == "UNCERTAIN"
    more = rules.unionByName(rules.limit(1).withColumn("claim_a_id", F.lit("p7")))  # undecided, but beyond the queue
    counts = verdicts.checkpoint_counts(verdicts.checkpoint_state(more, intake)).first()
    assert (counts.candidates_verified, counts.candidates_failed, counts.candidates_pending) == (4, 2, 0)


def test_strict_verdict_responses(spark):
    one = '{"candidate_id":"a","classification":"CONSISTENT","explanation":"e","confidence":%s}'
    cases = {'{"results":[' + one % "0.5" + "]}": None, '{"results":[],"results":[]}': "duplicate_field", '{"results":[' + one % "NaN" + "]}": "non_finite_number",
             '{"results":[' + one % "1e999" + "]}": "non_finite_number", '{"results":[' + one % '"0.5"' + "]}": "wrong_type", '{"results":[' + one % '1,"more":1' + "]}": "unexpected_fields",
             '{"results":[{"candidate_id":"a"}]}': "unexpected_fields", "[]": "unexpected_fields", "{": "malformed_json"}
    rows = responses.read_verdict_responses(spark.createDataFrame([(c,) for c in cases], "response string")).collect()
    assert {r.response: r.error for r in rows} == cases and rows[0].results[0].confidence == 0.5


def test_conflicting_registry_is_refused(spark):
    df = spark.createDataFrame([("sales",)], "k string")
    assert registry.alias_lookup(df, "k", "m", {"revenue": ["sales"], "cost": ["costs"]}).first().m == "revenue"
    for size in (0, 600):  # the size of a registry changes nothing
        with pytest.raises(ValueError, match="more than one metric"):
            registry.alias_lookup(df, "k", "m", {"revenue": ["sales"], "cost": ["Sales", *[f"a{i}" for i in range(size)]]})


def test_positions_without_common_prefixes(spark):
    rows = [("d", f"claim-with-one-prefix-{i:05d}", "z", round((i % 7) / 10, 1)) for i in range(500)]
    df = spark.createDataFrame(rows, "document_id string, claim_a_id string, claim_b_id string, score double")
    got = [r.claim_a_id for r in pairs.ranked(df).orderBy("position").collect()]
    assert got == [r[1] for r in sorted(rows, key=lambda r: (-r[3], r[1]))]


def test_visible_contradictions_need_equal_names(spark):
    claims = normalized(spark, [claim(1, 1), claim(2, 2), claim(3, 3, metric="profit")])
    fields = "document_id string, claim_a_id string, claim_b_id string, classification string, explanation string, confidence double, status string, source string"
    rows = [("d", "c0001", "c0002", "CONTRADICTION", "e", 0.9, "verified", "rules"), ("d", "c0001", "c0003", "CONTRADICTION", "e", 0.9, "verified", "rules"),
            ("d", "c0002", "c0009", "CONTRADICTION", "e", 0.9, "verified", "rules"), ("d", "c0002", "c0003", "CONSISTENT", "e", 0.9, "dismissed", "rules")]
    found = serving.visible_contradictions(spark.createDataFrame(rows, fields), claims).collect()
    assert [(r.claim_a_id, r.claim_b_id) for r in found] == [("c0001", "c0002")]


def test_claim_page(spark):
    rows = spark.createDataFrame([("d", i % 4 + 1, f"c{i:02d}") for i in range(30)], "document_id string, source_page int, claim_id string")
    page = serving.claim_page(rows, offset=8, limit=3)
    assert [(r.source_page, r.claim_id, r.total) for r in page.collect()] == [(2, "c01", 30), (2, "c05", 30), (2, "c09", 30)]
    assert "NestedLoop" not in page._jdf.queryExecution().executedPlan().toString()


def test_label_and_qualifier_rules(spark):
    df = spark.createDataFrame([("Audited ;  Consolidated",), ("audited, about",), ("  ",), (None,)], "q string")
    from claimloom.functions.text import label
    rows = df.select(label(F.col("q")).alias("l"), pairs.qualifier_is_plain(label(F.col("q"))).alias("p")).collect()
    assert [(r.l, r.p) for r in rows[:2]] == [("audited ; consolidated", True), ("audited, about", False)]
    assert rows[2].l is None and rows[3].l is None


def test_pairs_judged_together_equal_merged_pairs_looked_up(spark, sf):
    """Verdicts made where the pair join has both claims, against those of merged keys whose claims are looked up again."""
    rows, found = catalog.side_rows(spark, sf), pairs.labelled(catalog.candidates(spark, sf))
    similar = pairs.best_similarity(catalog_review.links(spark, sf))
    structured = found.select(*pairs.pair_ids(found), "preliminary_classification")
    looked_up = verdicts.judged(pairs.scored(pairs.pairs_by_key(pairs.merge_pairs(structured, similar), rows), F.col("similarity")))
    together = verdicts.judged_together(found, pairs.pairs_by_key(similar, rows)).select(*looked_up.columns)
    assert together.exceptAll(looked_up).count() == looked_up.exceptAll(together).count() == 0
    kinds = together.groupBy("is_structured", "is_semantic").count().count()
    assert kinds == 3 and catalog_review.all_verdicts(spark, sf).count() == together.count() > 0


def test_queue_and_intake_are_stored_before_they_meet_claims(spark, sf):
    """What is read from files has a known size; a queue that is still ranked inside the plan makes all claims shuffle to meet it."""
    for df in (catalog_review.evidence(spark, sf), catalog_review.checkpoint(spark, sf)):
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
