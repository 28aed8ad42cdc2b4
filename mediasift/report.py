"""Reports of a run: JSON for machines, text for people, and the exit code."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasift.operators import runtime
from mediasift.operators.verdict import word_reason


def report_table(media: DataFrame, verdicts: DataFrame, results: DataFrame) -> DataFrame:
    """One nested row an item: name, path, verdict, results in engine order. Write it with write.json at scale."""
    row = F.struct("engine_ord", F.col("engine").alias("name"), "status", "scores", "details")
    by_item = results.groupBy("media_id").agg(F.array_sort(F.collect_list(row), lambda x, y: x["engine_ord"] - y["engine_ord"]).alias("results"))
    verdict = F.struct("label", "nudity_risk", "violence_risk", "hate_risk", "reasons").alias("verdict")
    return media.select("media_id", "name", "path").join(verdicts.select("media_id", verdict), "media_id").join(by_item, "media_id", "left")


def worded(row: dict) -> dict:
    """A collected report row with its reasons in words."""
    row = dict(row)
    verdict = dict(row["verdict"])
    verdict["reasons"] = [word_reason(r["code"], r["note"], r["args"] or []) for r in verdict["reasons"]]
    row["verdict"] = verdict
    return row


def write_json(rows: list[dict], path: str | Path, inputs: int) -> None:
    """One object for one input, else an array; an error object if there was none."""
    body: object = {"error": "no inputs", "results": []} if inputs == 0 else rows[0] if inputs == 1 and rows else rows
    Path(path).write_text(json.dumps(body, ensure_ascii=False, indent=2), encoding="utf-8")


def text_lines(rows: list[dict]) -> list[str]:
    """A short report: one line an item and one a reason."""
    out = []
    for r in rows:
        v = r["verdict"]
        out.append(f"{'OK' if v['label'] == 'OK' else 'NOT_OK'} {v['label']} {r['name']} nudity={v['nudity_risk']:.2f} violence={v['violence_risk']:.2f} hate={v['hate_risk']:.2f}")
        out += [f"  - {reason}" for reason in v["reasons"]]
    return out


def benchmark(results: DataFrame, items: DataFrame, wall_ms: int) -> dict:
    """Runtime statistics of a run: results (engine, engine_ord, status, took_ms), items (media_id, total_ms, input_ord, label). A row an engine and ten items come to the driver."""
    summary = runtime.file_summary(items, wall_ms).first().asDict()
    counts = {r["label"]: r["items"] for r in runtime.verdict_counts(items).collect()}
    engines = [r.asDict() for r in runtime.engine_ranking(runtime.engine_rollup(results)).collect()]
    slow = runtime.slowest_files(items).drop("input_ord")
    found = slow.join(runtime.item_rollup(results, slow).drop("total_ms"), "media_id").join(runtime.item_engines(results), "media_id", "left").orderBy(F.desc("total_ms"), "media_id")
    return summary | {"verdict_counts": counts, "engines": engines, "slowest_files": [r.asDict(recursive=True) for r in found.collect()]}


def summary_lines(summary: dict) -> list[str]:
    """Runtime statistics in words."""
    v = summary["verdict_counts"]
    out = [f"files {summary['total_files']}, total {summary['total_ms']} ms, wall {summary['total_wall_ms']} ms, average {summary['avg_file_ms']:.2f} ms, least {summary['min_file_ms']} ms, median {summary['median_file_ms']} ms, p95 {summary['p95_file_ms']} ms, most {summary['max_file_ms']} ms"]
    out.append("verdicts " + ", ".join(f"{label} {v.get(label, 0)}" for label in runtime.LABELS))
    out += [f"engine {e['engine']}: runs {e['runs']}, ok {e['ok']}, skipped {e['skipped']}, errors {e['error']}, other {e['other_status']}, total {e['total_ms']} ms, average {e['avg_ms']:.2f} ms, p95 {e['p95_ms']} ms, most {e['max_ms']} ms" for e in summary["engines"]] or ["no engines"]
    return out + ([f"slow {f['media_id']}: {f['total_ms']} ms, {f['label']}, slowest engine {f['slowest_engine']} {f['slowest_engine_ms']} ms, unattributed {f['unattributed_ms']} ms" for f in summary["slowest_files"]] or ["no files"])


def exit_status(labels: list[str]) -> int:
    return 0 if labels and all(x == "OK" for x in labels) else 2
