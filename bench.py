"""Headline queries, timed end to end from the given tables (nothing is reused between runs).

Settings: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 1; the
median is reported).  One query is run on the smallest tables first, to start Python and load code.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from claimloom.operators import blocks, chunks, context, extract, normalize, pairs, serving, similar, verdicts  # noqa: E402
from claimloom.plans import catalog_vectors  # noqa: E402
from claimloom.session import materialize, prepare  # noqa: E402
from claimloom.sources import derived  # noqa: E402
from claimloom.sources import text as ts  # noqa: E402

CPUS = os.environ.get("BENCH_CPUS", "8")
SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))
SMALLEST = "/root/testdata/sf0.001"


def session() -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("claimloom-bench")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def claims(spark) -> DataFrame:
    return normalize.accepted(normalize.normalize_claims(derived.order_claims(spark, SF)))


def side_rows(spark) -> DataFrame:
    return materialize(pairs.sides(claims(spark)), "sides")


def reports(spark) -> DataFrame:
    rb = materialize(blocks.report_blocks(derived.report_items(spark, SF)), "blocks")
    return chunks.document_chunks(rb, materialize(context.table_context(rb), "context"))


def lines(spark) -> DataFrame:
    return chunks.document_chunks(blocks.blocks_from_items(ts.line_items(derived.table(spark, SF, "documents"))))


def visible(spark) -> DataFrame:
    stored = materialize(claims(spark), "claims")
    judged = verdicts.judged(pairs.scored(pairs.pairs_of(materialize(pairs.sides(stored), "sides"))))
    return serving.in_order(serving.visible_contradictions(judged, stored))


QUERIES = {
    "nrm_09_normalized_claims": claims,
    "pai_03_candidate_pairs": lambda spark: pairs.pairs_of(side_rows(spark)),
    "pai_10_class_counts": lambda spark: pairs.candidate_counts(side_rows(spark)),
    "pai_16_ranked_scores": lambda spark: pairs.ranked(pairs.above_threshold(pairs.scored(pairs.pairs_of(side_rows(spark)))).select(
        "document_id", F.col("a.claim_id").alias("claim_a_id"), F.col("b.claim_id").alias("claim_b_id"), "score")),
    "srv_01_visible_contradictions": visible,
    "emb_08_top_neighbours": lambda spark: similar.top_neighbours(catalog_vectors.vector_claims(spark, SF), threshold=0.3),
    "src_05_html_blocks": lambda spark: blocks.blocks_from_items(ts.html_items(derived.table(spark, SF, "pages"))),
    "chk_04_document_chunks": lines,
    "ext_document_claims": lambda spark: extract.extract_claims(materialize(lines(spark), "chunks")),
    "chk_10_report_chunks": reports,
    "ext_report_claims": lambda spark: extract.extract_claims(materialize(reports(spark), "chunks")),
}


def main() -> None:
    global SF
    spark, given = session(), SF
    if os.path.isdir(SMALLEST):
        SF = SMALLEST
        claims(spark).write.format("noop").mode("overwrite").save()
        SF = given
    times = {}
    for name, query in QUERIES.items():
        taken = []
        for _ in range(RUNS):
            start = time.time()
            query(spark).write.format("noop").mode("overwrite").save()
            taken.append(time.time() - start)
        times[name] = round(statistics.median(taken), 3)
        print(f"{name} {[round(t, 2) for t in taken]}", file=sys.stderr)
    print(json.dumps({"metric": "total seconds of the headline queries (median of runs)",
                      "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
