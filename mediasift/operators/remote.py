"""Calls to remote services from executors: pacing, retries, and what becomes of failures.

The transport is a function that the caller supplies (and Spark ships), so nothing here opens a connection.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasift.functions.columns import fetch_decision

#: Takes a request's payload, returns (HTTP status, body); raises for what is no HTTP answer.
Transport = Callable[[str], tuple[int, str]]
ANSWERS = "media_id string, status string, body string, error string, calls int"
FETCHED = "media_id string, content_type string, declared bigint, content binary, error string"


@dataclass(frozen=True)
class Pace:
    """How often and how long to try. Only 429 is tried again."""

    interval: float = 1.0
    retries: int = 3
    base: float = 1.0
    most: float = 10.0
    total: float = 30.0
    jitter: float = 0.25


def send(transport: Transport, payload: str, pace: Pace, sleep: Callable[[float], None] = time.sleep, spread: Callable[[], float] = random.random) -> tuple[int, str, int]:
    """(status, body, calls) of the last answer; waits grow twofold up to a limit, and so does their sum."""
    waited = 0.0
    for attempt in range(pace.retries + 1):
        status, body = transport(payload)
        wait = min(pace.most, pace.base * 2**attempt * (1 + pace.jitter * (2 * spread() - 1)))
        if status != 429 or attempt == pace.retries or waited + wait > pace.total:
            return status, body, attempt + 1
        sleep(wait)
        waited += wait
    raise AssertionError("unreachable")


def judge(style: str, status: int, body: str) -> tuple[str, str | None, bool]:
    """(result status, error, whether to stop calling) of an answer.

    moderation: every failure skips; a refused key stops further calls. frames: used-up quotas skip and stop,
    other failures are errors, and the body must say success.
    """
    if style == "moderation":
        if status in (401, 403) or re.search("deactivated|invalid api key|unauthorized", body, re.IGNORECASE) and status >= 400:
            return "skipped", f"auth http={status}", True
        return ("ok", None, False) if status < 400 else ("skipped", f"http={status}", False)
    if status in (402, 403, 429):
        return "skipped", f"quota/limit http={status}", True
    if status >= 400:
        return "error", f"http error {status}", False
    try:
        data = json.loads(body or "{}")
    except ValueError as e:
        return "error", f"invalid JSON response: {type(e).__name__}", False
    if not isinstance(data, dict) or data.get("status") != "success":
        told = str((data.get("error") or data.get("message") or data) if isinstance(data, dict) else data)
        if re.search("quota|limit", told, re.IGNORECASE):
            return "skipped", f"quota/limit: {told[:200]}", True
        return "error", told[:400], False
    return "ok", None, False


def call_remote(requests: DataFrame, transport: Transport, style: str = "moderation", pace: Pace | None = None, lanes: int = 1) -> DataFrame:
    """Answers to requests (media_id, payload), paced over `lanes` tasks together; a stop ends a lane's calls."""
    pace = pace or Pace()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, stopped = -float("inf"), None
        for batch in batches:
            rows = []
            for media_id, payload in zip(batch["media_id"], batch["payload"], strict=True):
                if stopped:
                    rows.append((media_id, "skipped", None, stopped, 0))
                    continue
                pause = last + pace.interval * lanes - time.monotonic()
                if pause > 0:
                    time.sleep(pause)
                last = time.monotonic()
                try:
                    code, body, calls = send(transport, payload, pace)
                    status, error, stop = judge(style, code, body)
                except (ValueError, RuntimeError, OSError) as e:
                    status, error, stop, body, calls = "error", f"{type(e).__name__}: {e}", False, None, 1
                stopped = error if stop else None
                rows.append((media_id, status, body if status == "ok" else None, error, calls))
            yield pd.DataFrame(rows, columns=["media_id", "status", "body", "error", "calls"])

    return requests.select("media_id", "payload").repartition(lanes).mapInPandas(run, ANSWERS)


def fetch(urls: DataFrame, transport: Callable[[str, int], tuple[str, int | None, bytes]], lanes: int = 8, limit: int = 25_000_000) -> DataFrame:
    """Contents of urls (media_id, url): error, ext, name, content. transport(url, limit) reads one byte more than the limit at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for media_id, url in zip(batch["media_id"], batch["url"], strict=True):
                try:
                    rows.append((media_id, *transport(url, limit), None))
                except (ValueError, RuntimeError, OSError) as e:
                    rows.append((media_id, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["media_id", "content_type", "declared", "content", "error"])

    got = urls.select("media_id", "url").repartition(lanes).mapInPandas(run, FETCHED).join(urls.select("media_id", "url"), "media_id")
    decided = fetch_decision(F.col("url"), F.col("content_type"), F.col("content"), F.octet_length("content"), F.col("declared"), limit)
    rows = got.withColumn("d", decided)
    error = F.coalesce("error", F.col("d.error"))
    return rows.select("media_id", error.alias("error"), F.when(error.isNull(), F.col("d.ext")).alias("ext"), F.when(error.isNull(), F.col("d.name")).alias("name"), F.when(error.isNull(), F.col("content")).alias("content"))
