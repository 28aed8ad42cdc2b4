"""Engines: what turns media into engine results, and the wrapper that turns failures into results."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasift.functions.columns import hex_of_bits
from mediasift.operators.matching import match_of_frames
from mediasift.operators.routing import ENGINE_ORDER
from mediasift.operators.text import text_check
from mediasift.sources.settings import switch

RESULTS = "media_id string, engine string, engine_ord int, status string, scores map<string,double>, details map<string,string>, error string"


#: Fixed value: characters of a searched text that its result shows.
SHOWN_TEXT = 2000


@dataclass(frozen=True)
class Engine:
    """A scorer. `run` takes media and returns media_id, scores, details and error (null where it went well)."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    available: bool = True
    why_not: str = ""

    @property
    def order(self) -> int:
        return ENGINE_ORDER.index(self.name) if self.name in ENGINE_ORDER else len(ENGINE_ORDER)

    def results(self, media: DataFrame) -> DataFrame:
        """One result row for each item; an engine that isn't available skips all."""
        head = [F.lit(self.name).alias("engine"), F.lit(self.order).alias("engine_ord")]
        none = F.create_map().cast("map<string,double>"), F.create_map().cast("map<string,string>")
        if not self.available:
            return media.select("media_id", *head, F.lit("skipped").alias("status"), none[0].alias("scores"), none[1].alias("details"), F.lit(self.why_not).alias("error"))
        found = self.run(media)
        status = F.when(F.col("error").isNull(), "ok").otherwise("error")
        return found.select("media_id", *head, status.alias("status"), F.coalesce("scores", none[0]).alias("scores"), F.coalesce("details", none[1]).alias("details"), F.col("error"))


def run_engines(media: DataFrame, engines: list[Engine]) -> DataFrame:
    """Results of all engines in one table; their order is a column, not the order of execution."""
    out = None
    for engine in engines:
        rows = engine.results(media)
        out = rows if out is None else out.unionByName(rows)
    return out


def _list_engine(name: str, score: str, empty: str, entries: DataFrame, radius: int) -> Engine:
    """The best match of an item's first and last frame hash (`first`, `last`, or `bits` for both) with a list."""

    def run(media: DataFrame) -> DataFrame:
        frames = media.select("media_id", *[F.col(c if c in media.columns else "bits").alias(c) for c in ("first", "last")])
        found = frames.join(match_of_frames(frames, entries, radius), "media_id", "left")
        hit = F.col("match_line").isNotNull()
        told = {"match_hex": hex_of_bits(F.col("match_bits")), "match_label": F.col("match_label"), "distance": F.col("distance").cast("string"), "matched_on": F.col("matched_on"), "first": hex_of_bits(F.col("first")), "last": hex_of_bits(F.col("last"))}
        details = F.map_filter(F.create_map(*[x for k, v in told.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
        return found.select("media_id", F.create_map(F.lit(score), F.when(hit, 1.0).otherwise(0.0)).alias("scores"), details.alias("details"), F.lit(None).cast("string").alias("error"))

    return Engine(name, run, bool(entries.limit(1).count()), empty)


def blocklist_engine(entries: DataFrame, radius: int = 6) -> Engine:
    """Nearest match within radius, equal hashes for radius 0; skipped when the list is empty."""
    return _list_engine("pHash blocklist", "phash_block_match", "blocklist empty", entries, radius)


def allowlist_engine(entries: DataFrame, radius: int = 0) -> Engine:
    """Equal hashes, or nearest for a radius above 0; skipped when the list is empty."""
    return _list_engine("pHash allowlist", "phash_allow_match", "allowlist empty", entries, radius)


def text_engine(patterns: list[str], least: int = 3) -> Engine:
    """The first listed pattern in the recognised `text`."""

    def run(media: DataFrame) -> DataFrame:
        found = text_check(media, "media_id", "text", patterns, least, SHOWN_TEXT)
        details = F.map_filter(F.create_map(F.lit("hit"), F.col("hit"), F.lit("text"), F.col("text")), lambda k, v: v.isNotNull())
        return found.select("media_id", F.create_map(F.lit("ocr_match"), F.col("ocr_match")).alias("scores"), details.alias("details"), F.lit(None).cast("string").alias("error"))

    return Engine("OCR text", run, bool(patterns), "ocr blocklist empty")


def table_engine(name: str, scores: DataFrame | None, failure: str = "no scores") -> Engine:
    """An engine whose model ran elsewhere: scores (media_id, scores) arrive as a table; items without a row are errors."""

    def run(media: DataFrame) -> DataFrame:
        joined = media.select("media_id").join(scores, "media_id", "left")
        return joined.select("media_id", "scores", F.lit(None).cast("map<string,string>").alias("details"), F.when(F.col("scores").isNull(), failure).alias("error"))

    return Engine(name, run, scores is not None, "not installed")


#: Settings that turn an engine off, with the value that does, and engines by stage.
SWITCHES = {"pHash blocklist": ("PHASH_BLOCK_DISABLE", "1"), "pHash allowlist": ("PHASH_ALLOW_DISABLE", "1"), "NudeNet": ("NUDENET_DISABLE", "1"), "OpenNSFW2": ("OPENNSFW2_DISABLE", None), "OpenAI Moderation": ("OPENAI_DISABLE", None), "Sightengine": ("SIGHTENGINE_DISABLE", None)}
REMOTE = ("OpenAI Moderation", "Sightengine")
FIRST = ("pHash blocklist", "pHash allowlist")


def stages(env: Mapping[str, str], no_apis: bool = False) -> tuple[list[str], list[str], list[str]]:
    """(list, local, remote) engine names of a run in order. Remote ones that are switched off are left out; others skip."""
    remote = [e for e in ENGINE_ORDER if e in REMOTE and not no_apis and not switch(env, SWITCHES[e][0], False)]
    return [e for e in ENGINE_ORDER if e in FIRST], [e for e in ENGINE_ORDER if e not in FIRST + REMOTE], remote


def switched_off(engine: str, env: Mapping[str, str]) -> str | None:
    """Why an engine skips by its settings; null if it doesn't. Text checks are off unless OCR_ENABLE is exactly 1."""
    if engine == "OCR text":
        return None if env.get("OCR_ENABLE", "").strip() == "1" else "OCR_ENABLE is not 1"
    key, value = SWITCHES.get(engine, ("", None))
    off = bool(key) and (env.get(key, "").strip() == value if value else switch(env, key, False))
    return f"{key} is set" if off else None
