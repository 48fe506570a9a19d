"""Text cleanup. Patterns use ``(?U)`` so that \\w, \\s, \\d and \\b are Unicode classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# White space is the Unicode White_Space set plus the four ASCII separators.
WS = r"[\s\x1c-\x1f]"
NOT_WS = r"[^\s\x1c-\x1f]"
DASHES = "‐‑–—-"
EDGE_CHARACTERS = " .,:;\t\n\r"
LEGAL_SUFFIXES = [(r"\bpvt\.?\b\.?", "private"), (r"\bltd\.?\b\.?", "limited"), (r"\binc\.?\b\.?", "incorporated")]
# Characters that can make a string differ from its NFC form: combining marks,
# conjoining Jamo, and the blocks that hold singleton or excluded compositions.
MAY_NEED_NFC = (
    r"[\p{M}\u0374\u037E\u0387\u0958-\u095F\u09DC-\u09DF\u0A33-\u0A5E\u0B5C\u0B5D\u0F43-\u0F69"
    r"\u1160-\u11FF\u1F71-\u1FFD\u2000\u2001\u2126\u212A\u212B\u2329\u232A\u2ADC\uF900-\uFB4E]"
    r"|[\x{1D15E}-\x{1D1C0}]|[\x{2F800}-\x{2FA1D}]"
)
# ---------------------------------------------------------------------------


def nfc(c: Column) -> Column:
    """Canonical composition through the ICU library that ships with Spark.

    Rows that cannot need it are passed through untouched.
    """
    composed = F.call_function(
        "reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    return F.when(c.rlike(MAY_NEED_NFC), composed).otherwise(c)


def strip(c: Column) -> Column:
    """Remove white space (any kind) from both ends."""
    return F.regexp_replace(c, rf"(?U)^{WS}+|{WS}+\z", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(rf"(?U){NOT_WS}")


def squeeze(c: Column) -> Column:
    """Collapse white space runs and strip the ends: the words joined by one space."""
    return F.btrim(F.regexp_replace(c, rf"(?U){WS}+", " "))


def clean_text(c: Column) -> Column:
    """Lower-case NFC text; underscores, spaces and inner dashes become one space."""
    lowered = F.lower(nfc(c))
    spaced = F.regexp_replace(lowered, r"(?U)[_\s\x1c-\x1f]+", " ")
    # the dash is matched first and its neighbours are looked at afterwards: most text has no dash
    undashed = F.regexp_replace(spaced, rf"(?U)[{DASHES}](?<=\w[{DASHES}])(?=\w)", " ")
    return F.btrim(undashed, F.lit(EDGE_CHARACTERS))


def entity_name(c: Column) -> Column:
    """Cleaned entity: leading article dropped, legal suffixes spelled out."""
    text = F.regexp_replace(clean_text(c), rf"(?U)^(?:the|this){WS}+", "")
    for pattern, word in LEGAL_SUFFIXES:
        text = F.regexp_replace(text, "(?U)" + pattern, word)
    return text


def label(c: Column) -> Column:
    """Comparison label: lower case, single spaces, blank is null; punctuation stays."""
    return F.nullif(squeeze(F.lower(c)), F.lit(""))


def unix_lines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def content_text(c: Column) -> Column:
    """Line endings and outer white space normalized; everything inside is kept."""
    return strip(unix_lines(c))


def content_hash(c: Column) -> Column:
    return F.sha2(content_text(c), 256)


def token_estimate(c: Column) -> Column:
    """One token per four code points, rounded up."""
    return F.ceil(F.length(c) / F.lit(4)).cast("int")
