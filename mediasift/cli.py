"""Moderate a file or folder of images against hash lists: python -m mediasift.cli INPUT [options]."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift import report
from mediasift.functions.columns import bits_of_hex, hex_of_bits
from mediasift.functions.imagehash import hash_of_image
from mediasift.operators import runtime
from mediasift.operators.engines import allowlist_engine, blocklist_engine, run_engines
from mediasift.operators.learning import LABELS, verdicts_in_order
from mediasift.operators.routing import moderate
from mediasift.scratch import materialise
from mediasift.session import local_session
from mediasift.sources import settings
from mediasift.sources.lists import append_hashes, read_hash_list, read_hash_store
from mediasift.sources.media import list_media, read_images

#: Inputs up to this number are shown one by one; reports of more are written by Spark.
MOST_SHOWN = 1000


#: What a run learns for a list stands in a store beside it.
LEARNED, AFTER_FILE = ".learned", 1 << 50


def hash_entries(spark: SparkSession, path: str, label: str) -> DataFrame:
    """The entries of a list file, followed by those that earlier runs learned for it."""
    listed, learned = read_hash_list(spark, path, label), read_hash_store(spark, path + LEARNED)
    return materialise(listed.unionByName(learned.withColumn("line_no", F.col("line_no") + AFTER_FILE).select(*listed.columns)), "entries")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="mediasift", description=__doc__)
    p.add_argument("input")
    p.add_argument("--recursive", action="store_true")
    p.add_argument("--no-apis", action="store_true")
    p.add_argument("--allowlist", default="allowlist.txt")
    p.add_argument("--blocklist", default="blocklist.txt")
    p.add_argument("--json")
    p.add_argument("--benchmark", action="store_true")
    p.add_argument("--benchmark-json")
    a = p.parse_args(argv)
    run = settings.resolve(settings.load(), a.no_apis)
    spark = local_session()
    began = time.time()
    listed = list_media(spark, a.input, a.recursive)
    inputs = listed.count()
    if not inputs:
        print("no inputs")
        if a.json:
            report.write_json([], a.json, 0)
        return 2
    if listed.filter("load_error is not null or source_kind = 'url'").count():  # a single input that can't be read here
        media = listed.withColumn("load_error", F.coalesce("load_error", F.lit("fetching needs a network transport"))).withColumn("bits", F.lit(None).cast("bigint"))
    else:
        images = read_images(spark, a.input, a.recursive)
        hashed = images.select("media_id", "load_error", bits_of_hex(hash_of_image("image")).alias("bits"))
        media = listed.select("media_id", "name", "path").join(hashed, "media_id", "left").withColumn("load_error", F.when(F.col("bits").isNull(), F.coalesce("load_error", F.lit("undecodable"))))
    media = materialise(media, "media")
    block, allow = hash_entries(spark, a.blocklist, "block"), hash_entries(spark, a.allowlist, "allow")
    lists = [blocklist_engine(block, run.block_distance), allowlist_engine(allow, run.allow_distance)]
    results = materialise(run_engines(media.filter("load_error is null"), lists), "results")
    none = results.limit(0)
    verdicts = materialise(moderate(media, lambda m: results.join(m.select("media_id"), "media_id", "left_semi"), lambda m: none, lambda m: none, run.settings, run.route), "verdicts")
    if run.route.short_circuit and any(map(run.learning.learns, LABELS.values())):
        turns = media.filter("bits is not null").orderBy("path").select("media_id", F.monotonically_increasing_id().alias("turn"), F.col("bits").alias("first"), F.col("bits").alias("last"))
        entries = block.select(F.lit("block").alias("list_kind"), "bits").unionByName(allow.select(F.lit("allow").alias("list_kind"), "bits"))
        verdicts, added = verdicts_in_order(turns, verdicts, entries, run.learning, run.block_distance, run.allow_distance)
        verdicts = materialise(verdicts, "in-order")
        for kind, path in (("block", a.blocklist), ("allow", a.allowlist)):
            append_hashes(added.filter(F.col("list_kind") == kind).select(hex_of_bits(F.col("bits")).alias("hex"), "label"), path + LEARNED)
    reports = report.report_table(media, verdicts, results)
    if inputs <= MOST_SHOWN:
        rows = [report.worded(r.asDict(recursive=True)) for r in reports.orderBy("path").collect()]
        print("\n".join(report.text_lines(rows)))
        if a.json:
            report.write_json(rows, a.json, inputs)
    elif a.json:
        reports.write.json(a.json)  # a folder with a line an item
    if a.benchmark or a.benchmark_json:
        wall = int(1000 * (time.time() - began))
        each = F.lit(wall // inputs)  # all items go through a stage together, so each has its share of the time
        items = media.select("media_id", each.alias("total_ms"), F.monotonically_increasing_id().alias("input_ord")).join(verdicts.select("media_id", "label"), "media_id")
        summary = report.benchmark(results.withColumn("took_ms", F.lit(None).cast("bigint")), items, wall)
        if a.benchmark:
            print("\n".join(report.summary_lines(summary)))
        if a.benchmark_json:
            Path(a.benchmark_json).write_text(json.dumps(summary, ensure_ascii=False, indent=2), encoding="utf-8")
    return runtime.exit_code(verdicts).first()["exit_code"]


if __name__ == "__main__":
    sys.exit(main())
