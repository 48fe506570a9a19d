"""Unit recognition: currencies with scale words, ratios, points and counts."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import clean_text

# --- fixed values -----------------------------------------------------------
CURRENCY_PATTERN = r"^(inr|₹|indian rupees?|usd|us\$|eur|€|gbp|£)\s*(.*)$"
CURRENCIES = {
    "inr": "INR", "₹": "INR", "indian rupee": "INR", "indian rupees": "INR",
    "usd": "USD", "us$": "USD", "eur": "EUR", "€": "EUR", "gbp": "GBP", "£": "GBP",
}
# scale word -> (canonical word, factor)
SCALES = {
    "": ("", "1"), "crore": ("crore", "10000000"), "crores": ("crore", "10000000"), "cr": ("crore", "10000000"),
    "million": ("million", "1000000"), "millions": ("million", "1000000"), "mn": ("million", "1000000"),
    "lakh": ("lakh", "100000"), "lakhs": ("lakh", "100000"), "thousand": ("thousand", "1000"),
    "billion": ("billion", "1000000000"),
}
# canonical -> (spellings, dimension, base unit, factor)
PLAIN_UNITS = {
    "percent": (["%", "percent", "percentage", "per cent", "pct"], "ratio", "ratio", "0.01"),
    "percentage_point": (["percentage point", "percentage points", "pp"], "percentage_point", "percentage_point", "1"),
    "basis_point": (["basis point", "basis points", "bps"], "percentage_point", "percentage_point", "0.01"),
    "employees": (["employee", "employees"], "count", "employees", "1"),
    "persons": (["person", "people", "persons"], "count", "persons", "1"),
    "shares": (["share", "shares"], "count", "shares", "1"),
}
SCALE_TYPE = "decimal(13,2)"
# ---------------------------------------------------------------------------


def literal_map(pairs: dict) -> Column:
    return F.create_map(*chain.from_iterable(
        (F.lit(k), v if isinstance(v, Column) else F.lit(v)) for k, v in pairs.items()))


def _facts(canonical, dimension, base, factor) -> Column:
    return F.struct(F.lit(canonical).alias("canonical"), F.lit(dimension).alias("dimension"),
                    F.lit(base).alias("base_unit"), F.lit(factor).cast(SCALE_TYPE).alias("scale"))


def with_unit(df: DataFrame, source: str, output: str) -> DataFrame:
    """Add ``output`` = ``struct<raw,canonical,dimension,base_unit,scale,recognized>`` and ``<output>_error``.

    A bare ``$`` or ``Rs`` stays unrecognized: no currency is assumed.
    """
    scales = literal_map({word: F.struct(F.lit(name).alias("name"), F.lit(factor).cast(SCALE_TYPE).alias("factor"))
                          for word, (name, factor) in SCALES.items()})
    plain = literal_map({spelling: _facts(name, *facts)
                         for name, (spellings, *facts) in PLAIN_UNITS.items() for spelling in spellings})
    text, base, scale, known = F.col("_unit"), F.col("_base"), F.col("_scale"), F.col("_plain")
    staged = (df.withColumn("_unit", clean_text(F.col(source)))
              .withColumn("_base", F.try_element_at(literal_map(CURRENCIES), F.regexp_extract(text, CURRENCY_PATTERN, 1)))
              .withColumn("_scale", F.when(base.isNotNull(), F.try_element_at(
                  scales, F.rtrim(F.regexp_extract(text, CURRENCY_PATTERN, 2), F.lit(".")))))
              .withColumn("_plain", F.when(scale.isNull(), F.try_element_at(plain, text))))
    money = scale.isNotNull()
    made = F.struct(
        F.col(source).alias("raw"),
        F.when(money, F.rtrim(F.concat(base, F.lit(" "), scale["name"]))).otherwise(
            F.coalesce(known["canonical"], text)).alias("canonical"),
        F.when(money, F.lit("currency")).otherwise(known["dimension"]).alias("dimension"),
        F.when(money, base).otherwise(known["base_unit"]).alias("base_unit"),
        F.when(money, scale["factor"]).otherwise(known["scale"]).alias("scale"),
        (money | known.isNotNull()).alias("recognized"),
    )
    return (staged.withColumn(output, F.when(F.col(source).isNotNull(), made))
            .withColumn(f"{output}_error", F.when(F.col(source).isNotNull() & (text == ""), F.lit("blank_unit")))
            .drop("_unit", "_base", "_scale", "_plain"))
