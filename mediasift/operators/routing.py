"""Stages of a run: loader failures, short circuits, gated remote checks, learning from verdicts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.operators.verdict import NO_REASONS, Settings, fold
from mediasift.scratch import materialise

Scorer = Callable[[DataFrame], DataFrame]

# The order in which results of engines stand.
ENGINE_ORDER = ("pHash blocklist", "pHash allowlist", "OCR text", "NudeNet", "OpenNSFW2", "YOLO-World weapons", "YOLO forbidden symbols", "OpenAI Moderation", "Sightengine")


def _reasons(code: str, note) -> object:
    return F.array(F.struct(F.lit(code).alias("code"), note.cast("string").alias("note"), F.array().cast("array<double>").alias("args"))).cast(NO_REASONS)


def loader_failures(media: DataFrame) -> DataFrame:
    """REVIEW verdicts of items (media_id, load_error) that couldn't be read; no rule looks at them."""
    failed = media.filter(F.col("load_error").isNotNull())
    zero = [F.lit(0.0).alias(f"{d}_risk") for d in ("nudity", "violence", "hate")]
    return failed.select("media_id", F.lit("REVIEW").alias("label"), *zero, _reasons("loader_failure", F.col("load_error")).alias("reasons"))


def list_verdict(blocked: Column, distance: Column) -> list[Column]:
    """Label, risks and reasons of an item that a list settles: the block list if blocked, else the allow list."""
    risks = [F.when(blocked, 1.0).otherwise(0.0).alias(f"{d}_risk") for d in ("nudity", "violence", "hate")]
    reasons = F.when(blocked, _reasons("blocklist_distance", distance)).otherwise(_reasons("allowlist_distance", distance))
    return [F.when(blocked, "BLOCK").otherwise("OK").alias("label"), *risks, reasons.alias("reasons")]


def settled_by_hash(pre_results: DataFrame) -> DataFrame:
    """Verdicts that the hash lists settle before any other check; a block match wins over an allow match."""
    hit = lambda engine, key: F.max(F.when((F.col("engine") == engine) & (F.lower("status") == "ok") & (F.try_element_at("scores", F.lit(key)) == 1.0), F.coalesce(F.try_element_at("details", F.lit("distance")), F.lit("")))  )
    found = pre_results.groupBy("media_id").agg(hit("pHash blocklist", "phash_block_match").alias("b"), hit("pHash allowlist", "phash_allow_match").alias("a"))
    found = found.filter("a is not null or b is not null")
    return found.select("media_id", *list_verdict(F.col("b").isNotNull(), F.coalesce("b", "a")))


@dataclass(frozen=True)
class Route:
    """How a run is staged."""

    short_circuit: bool = True
    api_policy: str = "always"
    no_apis: bool = False


def moderate(media: DataFrame, pre: Scorer, local: Scorer, remote: Scorer, settings: Settings | None = None, route: Route | None = None, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Verdicts of all media (media_id, load_error, …): hash lists, local engines, remote engines where the policy asks for them.

    Each scorer maps media to engine results. `keep` writes an intermediate table and reads it back, so that no
    scorer (a paid call) runs twice, even if executors are lost; by default in the shared folder.
    """
    route = route or Route()
    keep = keep or materialise
    readable = media.filter(F.col("load_error").isNull())
    first = keep(pre(readable), "pre")
    early = keep(settled_by_hash(first), "early") if route.short_circuit else None
    open_media = readable if early is None else readable.join(early.select("media_id"), "media_id", "left_anti")
    results = first.join(open_media.select("media_id"), "media_id", "left_semi").unionByName(keep(local(open_media), "local"))
    verdicts = fold(results, settings)
    policy = "never" if route.no_apis else route.api_policy
    if policy != "never":
        provisional = keep(verdicts, "provisional")
        asked = open_media if policy == "always" else open_media.join(provisional.filter("label = 'REVIEW'").select("media_id"), "media_id", "left_semi")
        added = keep(remote(asked), "remote")
        again = results.join(asked.select("media_id"), "media_id", "left_semi").unionByName(added)
        verdicts = provisional.join(asked.select("media_id"), "media_id", "left_anti").unionByName(fold(again, settings))
    parts = [verdicts, loader_failures(media)] + ([early] if early is not None else [])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass(frozen=True)
class Learning:
    """Which verdicts add hashes to the lists. `enabled` None: only the older switches count."""

    enabled: bool | None = None
    append: bool = False
    allow: bool | None = None
    block: bool | None = None
    first_and_last: bool = False
    allow_label: str = "ok"
    block_label: str = "not_ok"

    def _active(self) -> bool:
        return bool(self.enabled) if self.enabled is not None else self.append or bool(self.allow)

    def learns(self, label: str) -> bool:
        """The master switch turns both lists on unless one is switched off; older switches turn on only what they name."""
        chosen = {"OK": self.allow, "BLOCK": self.block}.get(label, False)
        return self._active() and (bool(chosen) or (chosen is None and bool(self.enabled)))


def learned(verdicts: DataFrame, hashes: DataFrame, how: Learning) -> DataFrame:
    """Hashes (list_kind, hex, label) that verdicts (media_id, label) add; hashes: media_id, first_hex, last_hex."""
    kinds = [(label, kind, name) for label, kind, name in (("OK", "allow", how.allow_label), ("BLOCK", "block", how.block_label)) if how.learns(label)]
    hexes = F.array_distinct(F.array("first_hex", "last_hex")) if how.first_and_last else F.array("first_hex")
    joined = verdicts.select("media_id", F.col("label").alias("_label")).join(hashes, "media_id")
    kind = F.lit(None).cast("string")
    name = F.lit(None).cast("string")
    for label, k, n in kinds:
        kind, name = F.when(F.col("_label") == label, k).otherwise(kind), F.when(F.col("_label") == label, n).otherwise(name)
    return joined.select(kind.alias("list_kind"), F.explode(hexes).alias("hex"), name.alias("label")).filter("list_kind is not null and hex is not null").distinct()
