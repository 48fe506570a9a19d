"""Phrase collocation mining by top-order marginalisation.

Only the longest windows are counted: every word of a piece opens one window of ``LONGEST`` words, made of the word and its lead columns, with
0 where the piece has ended.  A phrase of fewer words is a prefix of the windows that open with it, so ROLLUP over the lead columns
sums the counts of all shorter phrases from those of the windows; no phrase length is exploded for itself.

1. A dictionary gives every word that occurs ``least`` times in its language a number.  Rarer words cannot be in a phrase
   that is wanted and end a window as a piece does.
2. The windows are written in numbers.  A dictionary of checked size goes to every task, which shifts its columns and adds up equal windows;
   a larger one is joined to the words and the lead columns come from a window over (row, piece).
3. Windows meet by their first two words, packed into one number as the last two are.  A window is cut behind its longest prefix that is not
   rarer than ``least``: what lies behind it is in no phrase that is wanted.
4. ROLLUP over the lead columns adds up prefixes; those of at least ``least`` occurrences are phrases.  Parts of a candidate occur as often as it does, so all
   parts are among them.

Numbers are exact: counts are 64 bits, products decimals.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.llm.common import chosen
from claimloom.session import materialize

LONGEST = 4
LEAST = 30
KEPT_PERCENT = 80
FIRST = 2000
UNKNOWN = "und"
DICTIONARY_WORDS, DICTIONARY_BYTES = 500_000, 16 << 20  # what a dictionary sent to every task may hold
BUFFER = 1 << 20  # windows added up at once in a task
ENDS = ".,;:!?\n\x0b\x0c\r"
_END = b"\xff"  # a byte that no UTF-8 text holds
_NUMBERS = [f"w{i}" for i in range(1, LONGEST + 1)]
_PACKED = ["pair", "rest"]  # two numbers of 32 bits each
_TABLE = bytes(0xFF if chr(b) in ENDS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _pieces(texts: list[str | None]) -> bytes:
    """Texts in lower case, every end of a piece and of a text as the word _END."""
    return b"\xff".join((t or "").encode().translate(_TABLE) for t in texts).replace(_END, b" \xff ")


def _by_lang(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    texts: dict[str, list] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        texts.setdefault(UNKNOWN if lang is None else lang, []).append(text)
    return {lang: _pieces(found).split() for lang, found in texts.items()}


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n), stored; tasks add up their words first."""
    def rows(counts: dict[str, Counter]) -> pa.RecordBatch:
        flat = [(lang, word, n) for lang, found in counts.items() for word, n in found.items() if word != _END]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], pa.string()), pa.array([r[1] for r in flat], pa.binary()),
                                           pa.array([r[2] for r in flat], pa.int64())], names=["lang", "word", "n"])

    def work(batches):
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, words in _by_lang(batch).items():
                counts.setdefault(lang, Counter()).update(words)
            if sum(map(len, counts.values())) > BUFFER:
                yield rows(counts)
                counts = {}
        yield rows(counts)

    found = docs.select("lang", "text").mapInArrow(work, "lang string, word binary, n bigint")
    return materialize(found.groupBy("lang", F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n")), "words")


def dictionary(counts: DataFrame, least: int) -> DataFrame:
    """(number, lang, word) of the words with at least ``least`` occurrences, numbered from 1 without gaps; stored."""
    rows = materialize(counts.where(F.col("n") >= least).select("lang", "word"), "frequent").withColumn("row", F.monotonically_increasing_id())
    part = F.shiftright("row", 33)
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per input partition
    bases = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("base"))
    placed = rows.withColumn("part", part).join(bases, "part")
    return materialize(placed.select((F.col("base") + F.col("row").bitwiseAND((1 << 33) - 1) + 1).alias("number"), "lang", "word"), "dictionary")


def _leads(ids: np.ndarray) -> list[np.ndarray]:
    """The columns of the windows that open at each number; 0 ends a window."""
    columns = [ids]
    for i in range(1, LONGEST):
        lead = np.concatenate([ids[i:], np.zeros(min(i, len(ids)), np.int64)])
        columns.append(np.where(columns[-1] == 0, 0, lead))
    opens = ids != 0
    return [c[opens] for c in columns]


def _added_up(columns: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct windows in order, with their counts."""
    keys = [columns[i] << 32 | columns[i + 1] for i in range(0, LONGEST, 2)]
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))
    n = np.diff(np.append(new, len(order)))
    return pa.RecordBatch.from_arrays([*[pa.array(k[new]) for k in keys], pa.array(n)], names=[*_PACKED, "n"])


def _windows_by_dictionary(docs: DataFrame, words: DataFrame) -> DataFrame:
    numbers: dict[str, dict[bytes, int]] = {}
    for number, lang, word in words.collect():  # at most DICTIONARY_WORDS
        numbers.setdefault(lang, {})[word.encode()] = number
    known = docs.sparkSession.sparkContext.broadcast(numbers)

    def work(batches):
        waiting, size = [], 0
        for batch in batches:
            for lang, found in _by_lang(batch).items():
                get = known.value.get(lang, {}).get
                waiting.append(_leads(np.fromiter((get(w, 0) for w in found), np.int64, len(found))))
                size += len(waiting[-1][0])
            if size > BUFFER:
                yield _added_up([np.concatenate(c) for c in zip(*waiting)])
                waiting, size = [], 0
        if size:
            yield _added_up([np.concatenate(c) for c in zip(*waiting)])

    return docs.select("lang", "text").mapInArrow(work, ", ".join(f"{c} bigint" for c in [*_PACKED, "n"]))


def _windows_by_join(docs: DataFrame, words: DataFrame) -> DataFrame:
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.split(lower, f"[{ENDS}]").alias("pieces"))
    rows = rows.select("row", "lang", F.posexplode("pieces").alias("piece", "words"))
    rows = rows.select("row", "lang", "piece", F.posexplode(F.split("words", "[ \t]+")).alias("at", "word")).where("word <> ''")
    rows = rows.join(words, ["lang", "word"], "left").select("row", "piece", "at", F.coalesce("number", F.lit(0)).alias("w1"))
    in_piece = Window.partitionBy("row", "piece").orderBy("at")
    for i in range(2, LONGEST + 1):
        rows = rows.withColumn(f"w{i}", F.when(F.col(f"w{i - 1}") != 0, F.lead("w1", i - 1, 0).over(in_piece)).otherwise(0))
    packed = [F.shiftleft(f"w{i}", 32).bitwiseOR(F.col(f"w{i + 1}")).alias(name) for i, name in zip((1, 3), _PACKED)]
    return rows.where("w1 <> 0").select(*packed, F.lit(1).cast("bigint").alias("n"))


def windows(docs: DataFrame, words: DataFrame, most_words: int = DICTIONARY_WORDS) -> DataFrame:
    """(pair, rest, n): counts of the padded longest windows, in numbers of the dictionary; a window may have several rows."""
    size = words.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    fits = size[0] <= most_words and size[1] <= DICTIONARY_BYTES
    return _windows_by_dictionary(docs, words) if fits else _windows_by_join(docs, words)


def phrase_counts(counted: DataFrame, least: int) -> DataFrame:
    """(w1, ..., length, f) of all phrases with at least ``least`` occurrences, 0 behind their end; stored."""
    whole = counted.repartition("pair").groupBy(*_PACKED).agg(F.sum("n").alias("n"))  # dealt by the pair: no further exchange
    first, last = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND((1 << 32) - 1))
    opened = whole.select("pair", first("pair").alias("w1"), last("pair").alias("w2"), first("rest").alias("w3"), last("rest").alias("w4"), "n")
    often = lambda *prefix: F.sum("n").over(Window.partitionBy("pair", *prefix)) >= least
    told = opened.withColumn("often3", often("w3")).withColumn("often2", often())
    lasts = {"w2": F.col("often2"), "w3": F.col("often2") & F.col("often3"), "w4": F.col("often2") & F.col("often3") & (F.col("n") >= least)}
    cut = told.select("w1", *[F.when(frequent, F.col(c)).otherwise(0).alias(c) for c, frequent in lasts.items()], "n")
    summed = cut.rollup(*_NUMBERS).agg(F.sum("n").alias("f"), F.grouping_id().alias("rolled"))
    length = sum(F.col(c).isNotNull().cast("int") for c in _NUMBERS)
    # a prefix that ends in padding belongs to a shorter phrase, whose own row counts it
    found = summed.withColumn("length", length).where((F.col("f") >= least) & (F.col("length") > 0) & (F.element_at(F.array(*_NUMBERS), F.greatest("length", F.lit(1))) != 0))
    return materialize(found.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in _NUMBERS], "length", "f"), "phrases")


def _part(first: int, last: int) -> list:
    """Words first..last (from 1) as a phrase."""
    return [(F.col(f"w{first + i}") if first + i <= last else F.lit(0).cast("bigint")).alias(f"w{i + 1}") for i in range(LONGEST)]


def scored(phrases: DataFrame) -> DataFrame:
    """(w1, ..., length, a, l, r, score) of every phrase of two words and more, by its lowest-scoring cut."""
    cuts = F.array(*[F.when(F.col("length") > k, F.struct(F.lit(k).alias("k"), F.struct(*_part(1, k)).alias("first"), F.struct(*_part(k + 1, LONGEST)).alias("rest")))
                     for k in range(1, LONGEST)])
    cut = phrases.where("length > 1").select(*_NUMBERS, "length", F.col("f").alias("a"), F.explode(F.filter(cuts, lambda c: c.isNotNull())).alias("c"))
    parts = phrases.select(F.struct(*_NUMBERS).alias("part"), "f")
    both = (cut.select(*_NUMBERS, "length", "a", "c.k", F.col("c.first").alias("first"), F.col("c.rest").alias("rest"))
            .join(parts.select(F.col("part").alias("first"), F.col("f").alias("l")), "first").join(parts.select(F.col("part").alias("rest"), F.col("f").alias("r")), "rest"))
    score = F.expr("cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    lowest = both.withColumn("score", score).groupBy(*_NUMBERS, "length", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select(*_NUMBERS, "length", "a", "cut.l", "cut.r", "cut.score")


def not_inside(candidates: DataFrame, kept_percent: int) -> DataFrame:
    """Candidates that no longer candidate contains and (at ``kept_percent``) accounts for."""
    inside = [(length, F.struct(*_part(i, j))) for length in range(3, LONGEST + 1) for i in range(1, length) for j in range(i + 1, length + 1) if j - i + 1 < length]
    parts = F.filter(F.array(*[F.when(F.col("length") == length, part) for length, part in inside]), lambda p: p.isNotNull())
    longer = candidates.where("length > 2").select(F.explode(parts).alias("p"), F.col("a").alias("f")).groupBy("p").agg(F.max("f").alias("f"))
    covered = 100 * F.col("f").cast("decimal(19,0)") >= kept_percent * F.col("a").cast("decimal(19,0)")
    return candidates.join(longer.select("p.*", "f"), _NUMBERS, "left").where(~F.coalesce(covered, F.lit(False))).drop("f")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, kept_percent: int = KEPT_PERCENT, first: int = FIRST,
                 most_words: int = DICTIONARY_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` phrases of each language by score, then frequency, then bytes.

    A-Z are lower-cased, texts are split at ``. , ; : ! ?`` and line ends into pieces and those at spaces and tabs into words.  Null texts are
    empty, a null language is ``und``.  Repeated rows count each time.  Languages without a candidate have no row; an empty table
    gives an empty result; further columns are ignored.
    """
    docs = chosen(docs, lang=lang_col, text=text_col)
    counts = word_counts(docs)
    words = dictionary(counts, least)
    phrases = phrase_counts(windows(docs, words, most_words), least)
    found = not_inside(materialize(scored(phrases), "scored"), kept_percent)
    for i, number in enumerate(_NUMBERS, 1):
        named = words.select(F.col("number").alias(number), F.col("word").alias(f"word{i}"), *([F.col("lang")] if i == 1 else []))
        found = found.join(named, number, "inner" if i == 1 else "left")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (found.withColumn("phrase", F.concat_ws(" ", *[f"word{i}" for i in range(1, LONGEST + 1)]))
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= first).join(totals, "lang")
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
