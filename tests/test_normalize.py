import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimloom.functions import text
from claimloom.functions.periods import PeriodPolicy, with_period
from claimloom.functions.units import with_unit
from claimloom.operators import normalize
from claimloom.sources import registry

UNITS = [
    ("INR Cr.", "INR crore", "currency", "INR", 10_000_000, True), ("US$", "USD", "currency", "USD", 1, True),
    ("€ mn", "EUR million", "currency", "EUR", 1_000_000, True), ("%", "percent", "ratio", "ratio", 0.01, True),
    ("per cent", "percent", "ratio", "ratio", 0.01, True),
    ("bps", "basis_point", "percentage_point", "percentage_point", 0.01, True),
    ("employees", "employees", "count", "employees", 1, True), ("Indian Rupees", "INR", "currency", "INR", 1, True),
    ("Cr", "cr", None, None, None, False), ("million", "million", None, None, None, False),
    ("Rs", "rs", None, None, None, False), ("$", "$", None, None, None, False), ("₹ 5 crore", "₹ 5 crore", None, None, None, False),
]

PERIODS = [
    ("FY25", "FY25", "fiscal_year", None, None), ("Fiscal Year 2025", "FY2025", "fiscal_year", None, None),
    ("Year ended March 31, 2025", "year_ended:2025-03-31", "year_ended", None, "2025-03-31"),
    ("31 Mar. 2025", "2025-03-31", "date", None, "2025-03-31"), ("2025-03-31", "2025-03-31", "date", None, "2025-03-31"),
    ("March 2025", "2025-03", "month", "2025-03-01", "2025-03-31"), ("2025-03", "2025-03", "month", "2025-03-01", "2025-03-31"),
    ("2025", "2025", "year", None, None), ("Q1 2025", "q1 2025", "unknown", None, None),
    ("year ended soon", "year ended soon", "unknown", None, None), ("Sometember 3, 2025", "sometember 3, 2025", "unknown", None, None),
]


def test_units(spark):
    rows = with_unit(spark.createDataFrame([(u[0],) for u in UNITS], "unit string"), "unit", "u").select("unit", "u.*").collect()
    found = {r.unit: (r.canonical, r.dimension, r.base_unit, None if r.scale is None else float(r.scale), r.recognized) for r in rows}
    assert found == {u[0]: u[1:] for u in UNITS}


def test_blank_unit_is_an_error(spark):
    row = with_unit(spark.createDataFrame([(" ;",), (None,)], "unit string"), "unit", "u").collect()
    assert [r.u_error for r in row] == ["blank_unit", None]
    assert row[1].u is None


def test_periods(spark):
    rows = with_period(spark.createDataFrame([(p[0],) for p in PERIODS], "period string"), "period", "p").select("period", "p.*").collect()
    found = {r.period: (r.canonical, r.kind, r.start_date and str(r.start_date), r.end_date and str(r.end_date)) for r in rows}
    assert found == {p[0]: p[1:] for p in PERIODS}
    assert all(r.error is None for r in rows)


@pytest.mark.parametrize("bad", ["2025-02-30", "0000", "2025-13", "year ended 2025-02-30", "Feb 30, 2025", "fy0000", "  "])
def test_bad_periods(spark, bad):
    row = with_period(spark.createDataFrame([(bad,)], "period string"), "period", "p").select("p.*").first()
    assert row.error is not None and row.canonical is None


def test_fiscal_policy(spark):
    policy = PeriodPolicy(fiscal_year_end_month=3, fiscal_year_end_day=31, resolve_fiscal_dates=True)
    row = with_period(spark.createDataFrame([("FY 2025",)], "period string"), "period", "p", policy).select("p.*").first()
    assert (row.start_date, row.end_date) == (dt.date(2024, 4, 1), dt.date(2025, 3, 31))
    with pytest.raises(ValueError):
        PeriodPolicy(two_digit_century=1800)


def test_names(spark):
    cases = {"The Acme Pvt. Ltd.": "acme private limited", "This Beta–Gamma Inc": "beta gamma incorporated",
             "Éclair_Co": "éclair co", "  a b—c ": "a b c", "pre-é-post": "pre é post"}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", text.entity_name(F.col("raw")).alias("n")).collect()
    assert {r.raw: r.n for r in rows} == cases


def test_metrics(spark):
    cases = {"No. of Employees": "employee_count", "Licensed Beds": "licensed_bed_count", "Operating-Margin": "operating_margin",
             "revenue from operations": "revenue_from_operations", "Total Revenue": "revenue"}
    claims = spark.createDataFrame([(f"c{i}", m) for i, m in enumerate(cases)], "claim_id string, metric_raw string").select(
        "claim_id", "metric_raw", F.lit("Acme").alias("entity_raw"), F.lit(None).cast("string").alias("unit"),
        F.lit(None).cast("string").alias("period"), F.lit("d").alias("document_id"))
    found = {r.metric_raw: r.metric_n for r in normalize.normalize_claims(claims).collect()}
    assert found == cases
    large = {f"metric_{i}": [f"alias number {i}"] for i in range(600)} | {"revenue": ["turnover", "total revenue"]}
    joined = {r.metric_raw: r.metric_n for r in normalize.normalize_claims(claims, metrics=large).collect()}
    assert joined["Total Revenue"] == "revenue" and joined["Licensed Beds"] == "licensed_beds"


def test_rejects_do_not_fail_the_job(spark):
    claims = spark.createDataFrame([("a", " . ", "m", None, None), ("b", "E", "  ", None, None), ("c", "E", "m", ".", None),
                                    ("d", "E", "m", None, "2025-02-30"), ("e", "E", "m", None, None)],
                                   "claim_id string, entity_raw string, metric_raw string, unit string, period string").withColumn("document_id", F.lit("d"))
    n = normalize.normalize_claims(claims)
    assert {r.item_id: r.message for r in normalize.rejected(n).collect()} == {
        "a": "blank_entity", "b": "blank_metric", "c": "blank_unit", "d": "invalid_period"}
    assert [r.claim_id for r in normalize.accepted(n).collect()] == ["e"]


def test_registry_file(tmp_path, spark):
    good = tmp_path / "good.json"
    good.write_text('{"version": 1, "metrics": {"revenue": ["turnover"]}}')
    assert registry.read_metric_registry(str(good)) == {"revenue": ["turnover"]}
    for text_, word in [('{"version": 1, "version": 1, "metrics": {}}', "repeated"), ('{"version": 2, "metrics": {}}', "version"),
                        ('{"version": 1, "metrics": {"a": [1]}}', "strings"), ('{"version": 1}', "exactly")]:
        bad = tmp_path / "bad.json"
        bad.write_text(text_)
        with pytest.raises(ValueError, match=word):
            registry.read_metric_registry(str(bad))
    rows = registry.registry_rows(spark, {"Bad Name": ["x"], "good": ["X", " "]})
    assert {r.rule for r in registry.audit_registry(rows).collect()} == {"canonical_not_snake_case", "blank_alias", "conflicting_alias"}
