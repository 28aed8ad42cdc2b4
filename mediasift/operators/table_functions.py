"""Engines as table functions: `engine_results` turns the rows of items into one result an item, from SQL.

    SELECT * FROM engine_results(TABLE(frames) PARTITION BY media_id ORDER BY idx, engine => 'package.module:Class')

An engine is a class with `name`, `available()` (whether it can run, and why not), `begin()` for a new item, `add(row)` for each of
its rows in order, and `result()` (scores, details) at the item's end. It is made once in a Python worker, however many
items and tasks the worker gets, and sees an item's rows one after the other, so no item is held whole.

The result's media_id has the type that the table's has, and columns named in `keep` come along from an item's last row.
What fails becomes a row: an engine that isn't available skips the item, and any failure while it runs is an error of
that item alone. Without PARTITION BY every task's rows are one item.
"""

from __future__ import annotations

import importlib
import time

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, LongType, MapType, Row, StringType, StructType

FUNCTION = "engine_results"
_MADE: dict[str, object] = {}


def engine_of(path: str) -> object:
    """The engine named `module:Class`, made once a worker."""
    if path not in _MADE:
        module, _, name = path.partition(":")
        _MADE[path] = getattr(importlib.import_module(module), name)()
    return _MADE[path]


def _kept(keep: str | None) -> list[str]:
    return [c.strip() for c in (keep or "").split(",") if c.strip()]


class EngineResults:
    @staticmethod
    def analyze(rows: AnalyzeArgument, engine: AnalyzeArgument, keep: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable or "media_id" not in rows.dataType.fieldNames():
            raise ValueError("the first argument is a table with a column media_id")
        for given in (engine, keep):
            if given is not None and (not given.isConstantExpression or not isinstance(given.dataType, StringType)):
                raise ValueError("engine and keep are constant strings")
        if ":" not in (engine.value or ""):
            raise ValueError("an engine is named as module:Class")
        table, schema = rows.dataType, StructType().add("media_id", rows.dataType["media_id"].dataType)
        for c in _kept(keep.value if keep else None):
            schema = schema.add(c, table[c].dataType)
        schema = schema.add("engine", StringType()).add("status", StringType()).add("scores", MapType(StringType(), DoubleType()))
        return AnalyzeResult(schema.add("details", MapType(StringType(), StringType())).add("error", StringType()).add("took_ms", LongType()))

    def __init__(self) -> None:
        self.engine, self.last, self.failed, self.began, self.why = None, None, None, time.monotonic(), None

    def eval(self, rows: Row, engine: str, keep: str | None = None) -> None:
        first, self.last, self.keep, self.named = self.last is None, rows, _kept(keep), engine
        if first:
            self._try(lambda: self._begin(engine))
        if self.engine is not None and self.failed is None:
            self._try(lambda: self.engine.add(rows))

    def _begin(self, path: str) -> None:
        engine = engine_of(path)
        ok, why = engine.available()
        if ok:
            engine.begin()
            self.engine = engine
        else:
            self.why = why

    def _try(self, step) -> object:
        try:
            return step()
        except Exception as e:  # an engine's failure is its item's result, never the job's end
            self.failed = f"{type(e).__name__}: {e}"
            return None

    def terminate(self):
        if self.last is None:
            return
        found = self._try(self.engine.result) if self.engine is not None and self.failed is None else None
        scores, details = found if found is not None else ({}, {})
        status = "error" if self.failed else "skipped" if self.why is not None else "ok"
        name = getattr(_MADE.get(self.named), "name", self.named)
        took = int((time.monotonic() - self.began) * 1000)
        yield (self.last["media_id"], *[self.last[c] for c in self.keep], name, status, {k: float(v) for k, v in scores.items()}, {k: str(v) for k, v in details.items()}, self.failed or self.why, took)


def register_engines(spark: SparkSession) -> None:
    """Make `engine_results` known to SQL."""
    spark.udtf.register(FUNCTION, udtf(EngineResults))


class PeakScore:
    """The highest `confidence` of an item's rows and the `label` that has it, the first one of equals; a row without either is an error."""

    name = "Peak score"

    def available(self) -> tuple[bool, str]:
        return True, ""

    def begin(self) -> None:
        self.best, self.label, self.rows = None, None, 0

    def add(self, row: Row) -> None:
        if row["label"] is None or row["confidence"] is None:
            raise ValueError(f"row {self.rows} has no score")
        if self.best is None or row["confidence"] > self.best:
            self.best, self.label = row["confidence"], row["label"]
        self.rows += 1

    def result(self) -> tuple[dict[str, float], dict[str, str]]:
        return {"peak": self.best, "rows": self.rows}, {"label": self.label}
