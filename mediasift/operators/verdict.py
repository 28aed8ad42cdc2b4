"""Engine results folded into one verdict for each item, by a table of rules.

A rule looks at the scores of one engine and may raise a risk, give a reason, or settle the verdict. The
results of an item are few (one an engine), so they are gathered into an array in engine order by one
shuffle; array functions then find the first settling result, drop what comes after it, take the highest
risks and line up the reasons. Reasons stay codes with numbers; `reason_texts` words them for reports.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediasift.functions.columns import CORE_ENGINES

RISKS = ("nudity", "violence", "hate")
NOTHING_RAN = "no_checks_ran"


@dataclass(frozen=True)
class Settings:
    """Thresholds and policies of a run; resolved once on the driver."""

    block: float = 0.85
    review: float = 0.40
    core: tuple[str, ...] = CORE_ENGINES
    error_policy: str = "review"
    no_checks_policy: str = "review"
    symbol_block: float = 0.90
    symbol_review: float = 0.30
    firearm: float = 0.35
    toy: float = 0.25
    allow_toy: bool = False
    dangerous_knife: float = 0.35
    knife: float = 0.65
    block_all_knives: bool = False
    se_firearm: float = 0.35
    se_block_any_firearm: bool = False
    se_violence: float = 0.30
    se_gore: float = 0.20
    se_offensive: float = 0.50
    se_knife: float = 0.65
    se_block_all_knives: bool = False
    se_knife_context: float = 0.25


@dataclass(frozen=True)
class Rule:
    """Where `reason` holds the code is given with `args`; `risk` raises the risk `dim` in any case."""

    engine: str
    code: str
    dim: str
    risk: Column
    reason: Column
    args: tuple[Column, ...] = ()
    prefix: bool = False


@dataclass(frozen=True)
class Settling:
    """Where `when` holds the verdict is `label` with all risks at `risk`."""

    engine: str
    code: str
    label: str
    risk: float
    when: Column


# The scores that rules read. Sub-scores of the second list are not clamped.
CLAMPED = (
    "phash_allow_match",
    "phash_block_match",
    "ocr_match",
    "sexual/minors",
    "sexual",
    "violence",
    "violence/graphic",
    "hate",
    "hate/threatening",
    "nsfw_probability",
    "nudity_exposed",
    "nudity_covered",
    "nsfw_combined",
    "forbidden_symbols_max_conf",
    "yolo_firearm_toy",
    "yolo_firearm",
    "yolo_firearm_realistic",
    "yolo_knife_dangerous",
    "yolo_knife",
    "nudity_safe",
    "nudity_raw",
    "nudity_partial",
    "weapon_firearm",
    "weapon_firearm_toy",
    "weapon_firearm_gesture",
    "violence_prob",
    "violence_physical_violence",
    "violence_firearm_threat",
    "gore_prob",
    "weapon_knife",
    "offensive_max",
)
RAW = (
    "weapon_firearm_type_animated",
    "gore_very_bloody",
    "gore_slightly_bloody",
    "gore_serious_injury",
    "gore_superficial_injury",
    "gore_corpse",
    "gore_body_organ",
)


def _score(name: str) -> Column:
    return F.col(f"`s:{name}`")


_raw = _score


def _scores() -> list[Column]:
    """One column for each score that a rule reads, so that no rule repeats how it is cleaned."""
    clean = "CASE WHEN {x} IS NOT NULL AND NOT isnan({x}) AND abs({x}) <> double('infinity') THEN least(1D, greatest(0D, {x})) ELSE 0D END AS `s:{n}`"
    at = "try_element_at(scores, '{n}')"
    return [F.expr(clean.format(x=at.format(n=n), n=n)) for n in CLAMPED] + [F.expr(f"coalesce({at.format(n=n)}, 0D) AS `s:{n}`") for n in RAW]


def settling_rules() -> list[Settling]:
    return [
        Settling("pHash allowlist", "allowlist_match", "OK", 0.0, _score("phash_allow_match") >= 1),
        Settling("pHash blocklist", "blocklist_match", "BLOCK", 1.0, _score("phash_block_match") >= 1),
        Settling("OCR text", "text_blocked", "BLOCK", 1.0, _score("ocr_match") >= 1),
        Settling("OpenAI Moderation", "minors", "BLOCK", 1.0, _score("sexual/minors") > 0.01),
    ]


def rules(s: Settings) -> list[Rule]:
    """The rules that raise risks, in the order in which their reasons stand."""

    def alarm(engine: str, code: str, when: Column, *args: Column, dim: str = "violence") -> Rule:
        return Rule(engine, code, dim, F.when(when, 1.0).otherwise(0.0), when, args)

    def level(engine: str, code: str, dim: str, value: Column, least: float, shown: Column | None = None, prefix: bool = False) -> Rule:
        return Rule(engine, code, dim, value, value >= least, (value if shown is None else shown,), prefix)

    remote = "OpenAI Moderation"
    api, weapons, symbols = "Sightengine", "YOLO-World weapons", "YOLO forbidden symbols"
    top = _score("forbidden_symbols_max_conf")
    toy, firearm, real = _score("yolo_firearm_toy"), _score("yolo_firearm"), _score("yolo_firearm_realistic")
    dangerous, knife = _score("yolo_knife_dangerous"), _score("yolo_knife")
    safe = _score("nudity_safe")
    partial = F.when(safe > 0, F.least(_score("nudity_partial"), F.greatest(F.lit(0.0), 1 - safe))).otherwise(_score("nudity_partial"))
    se_firearm, se_toy, se_gesture, animated = _score("weapon_firearm"), _score("weapon_firearm_toy"), _score("weapon_firearm_gesture"), _raw("weapon_firearm_type_animated")
    se_real = se_firearm * (1 - F.greatest(se_toy, se_gesture, animated))
    prob, physical, threat = _score("violence_prob"), _score("violence_physical_violence"), _score("violence_firearm_threat")
    fight = F.greatest(prob, physical, threat)
    gore = F.greatest(_score("gore_prob"), *[_raw(f"gore_{x}") for x in ("very_bloody", "slightly_bloody", "serious_injury", "superficial_injury", "corpse", "body_organ")])
    se_knife, context = _score("weapon_knife"), F.greatest(fight, gore)
    offensive = _score("offensive_max")
    return [
        level(remote, "openai_sexual", "nudity", _score("sexual"), 0.50),
        level(remote, "openai_violence", "violence", F.greatest(_score("violence"), _score("violence/graphic")), 0.50),
        level(remote, "openai_hate", "hate", F.greatest(_score("hate"), _score("hate/threatening")), 0.50),
        level("OpenNSFW2", "opennsfw2", "nudity", _score("nsfw_probability"), 0.50),
        level("NudeNet", "nudenet_exposed", "nudity", _score("nudity_exposed"), 0.40),
        level("NudeNet", "nudenet_covered", "nudity", _score("nudity_covered") * 0.5, 0.60, _score("nudity_covered")),
        level("NSFWJS", "nsfwjs", "nudity", _score("nsfw_combined"), 0.50, prefix=True),
        alarm(symbols, "symbol_detected", top >= s.symbol_block, top, dim="hate"),
        Rule(symbols, "symbol_possible", "hate", F.when((top < s.symbol_block) & (top >= s.symbol_review), s.review).otherwise(0.0), (top < s.symbol_block) & (top >= s.symbol_review), (top,)),
        alarm(weapons, "firearm_realistic", real >= s.firearm, real),
        alarm(weapons, "firearm_like", F.lit(not s.allow_toy) & ((toy >= s.toy) | (firearm >= s.firearm)), F.greatest(toy, firearm)),
        alarm(weapons, "knife_dangerous", dangerous >= s.dangerous_knife, dangerous),
        alarm(weapons, "knife", F.lit(s.block_all_knives) & (knife >= s.knife), knife),
        level(api, "se_nudity_raw", "nudity", _score("nudity_raw"), 0.30),
        level(api, "se_nudity_partial", "nudity", partial * 0.6, 0.42, partial),
        alarm(api, "se_firearm_any", F.lit(s.se_block_any_firearm) & (se_firearm >= s.se_firearm), se_firearm, se_toy, se_gesture, animated),
        alarm(api, "se_firearm", se_real >= s.se_firearm, se_real, se_firearm, se_toy, se_gesture, animated),
        alarm(api, "se_violence", fight >= s.se_violence, prob, physical, threat),
        alarm(api, "se_gore", gore >= s.se_gore, gore, _score("gore_prob")),
        alarm(api, "se_offensive", offensive >= s.se_offensive, offensive, dim="hate"),
        alarm(api, "se_knife", (se_knife >= s.se_knife) & (F.lit(s.se_block_all_knives) | (context >= s.se_knife_context)), se_knife, context),
    ]


def _part(name: str):
    return lambda row: row[name]


def _reason(code: str, note: Column, args: Iterable[Column]) -> Column:
    values = [a.cast("double") for a in args]
    return F.struct(F.lit(code).alias("code"), note.cast("string").alias("note"), (F.array(*values) if values else F.array().cast("array<double>")).alias("args"))


NO_REASONS = "array<struct<code:string,note:string,args:array<double>>>"


def fold(results: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One verdict for each media_id of results (media_id, engine, engine_ord, status, scores, details)."""
    s = settings or Settings()
    told = F.coalesce(F.try_element_at("details", F.lit("match_label")), F.try_element_at("details", F.lit("top_label")))
    results = results.select("media_id", "engine", "engine_ord", F.lower("status").alias("status"), told.alias("note"), *_scores())
    status, note = F.col("status"), F.col("note")
    ran = status == "ok"
    settle, settled_risk, settled_reason = (F.lit(None).cast(t) for t in ("string", "double", "struct<code:string,note:string,args:array<double>>"))
    for r in reversed(settling_rules()):
        hit = ran & (F.col("engine") == r.engine) & r.when
        settle = F.when(hit, r.label).otherwise(settle)
        settled_risk = F.when(hit, r.risk).otherwise(settled_risk)
        settled_reason = F.when(hit, _reason(r.code, note, ())).otherwise(settled_reason)
    risk = {d: [] for d in RISKS}
    reasons = []
    for r in rules(s):
        mine = ran & (F.col("engine").startswith(r.engine) if r.prefix else F.col("engine") == r.engine)
        risk[r.dim].append(F.when(mine, r.risk).otherwise(0.0))
        reasons.append(F.when(mine & r.reason, _reason(r.code, note, r.args)))
    row = F.struct(
        F.col("engine_ord").alias("ord"),
        F.col("engine"),
        status.alias("status"),
        settle.alias("settle"),
        settled_risk.alias("settled_risk"),
        settled_reason.alias("settled_reason"),
        *[F.greatest(F.lit(0.0), *risk[d]).alias(d) for d in RISKS],
        F.filter(F.array(*reasons), lambda x: x.isNotNull()).alias("reasons"),
    )
    rows = results.select("media_id", row.alias("row")).groupBy("media_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    failed = F.filter("rows", lambda r: r["status"] == "error")
    core = F.filter(failed, lambda r: r["engine"].isin(*s.core)) if s.core else failed
    names = lambda found: F.array_join(F.transform(F.slice(found, 1, 6), lambda r: r["engine"]), ", ")
    rows = rows.withColumns({"_core": F.size(core) > 0, "_first": F.when(F.size(core) > 0, F.array(_reason("core_failed", names(core), ()))).when(F.size(failed) > 0, F.array(_reason("other_failed", names(failed), ()))).otherwise(F.array().cast(NO_REASONS))})
    rows = rows.withColumn("_none", ~F.exists("rows", lambda r: r["status"] == "ok"))
    rows = rows.withColumn("_end", F.get(F.filter("rows", lambda r: r["settle"].isNotNull()), F.lit(0)))
    live = F.filter("rows", lambda r: (r["status"] == "ok") & (F.col("_end").isNull() | (r["ord"] < F.col("_end")["ord"])))
    rows = rows.withColumn("_live", live)
    early = F.when(F.col("_core") & F.lit(s.error_policy == "block"), "BLOCK")
    floor = F.when(F.col("_core") & F.lit(s.error_policy == "block"), 0.5).when(F.col("_core") & F.lit(s.error_policy == "review"), 0.40).otherwise(0.0)
    none_label = {"ok": "OK", "block": "BLOCK"}.get(s.no_checks_policy, "REVIEW")
    stop = early.isNotNull() | F.col("_none")
    risks = {d: F.when(stop, floor).when(F.col("_end").isNotNull(), F.col("_end")["settled_risk"]).otherwise(F.greatest(floor, F.coalesce(F.array_max(F.transform("_live", _part(d))), F.lit(0.0)))) for d in RISKS}
    rows = rows.select("*", *[c.alias(f"{d}_risk") for d, c in risks.items()])
    highest = F.greatest(*[F.col(f"{d}_risk") for d in RISKS])
    label = F.coalesce(early, F.when(F.col("_none"), none_label), F.col("_end")["settle"], F.when(highest >= s.block, "BLOCK").when(highest >= s.review, "REVIEW").otherwise("OK"))
    given = F.flatten(F.transform("_live", lambda r: r["reasons"]))
    told = (
        F.when(early.isNotNull(), F.col("_first"))
        .when(F.col("_none"), F.concat("_first", F.array(_reason(NOTHING_RAN, F.lit(None), ()))))
        .when(F.col("_end").isNotNull(), F.concat("_first", given, F.array(F.col("_end")["settled_reason"])))
        .otherwise(F.concat("_first", given))
    )
    rows = rows.select("media_id", label.alias("label"), *[f"{d}_risk" for d in RISKS], told.alias("reasons"))
    borderline = (F.col("label") != "OK") & (F.size("reasons") == 0)
    return rows.withColumn("reasons", F.when(borderline, F.array(_reason("borderline", F.lit(None), ()))).otherwise(F.col("reasons")))


#: Wording of reasons by code; {} are numbers with two decimals.
WORDING = {
    "core_failed": "Some checks failed: NOTE",
    "other_failed": "Non-core checks failed (ignored): NOTE",
    NOTHING_RAN: "No checks ran (all engines skipped/disabled).",
    "allowlist_match": "pHash allowlist match",
    "blocklist_match": "pHash blocklist match",
    "text_blocked": "OCR text blocked",
    "minors": "OpenAI: sexual/minors detected",
    "openai_sexual": "OpenAI sexual={}",
    "openai_violence": "OpenAI violence={}",
    "openai_hate": "OpenAI hate={}",
    "opennsfw2": "OpenNSFW2 NSFW={}",
    "nudenet_exposed": "NudeNet exposed={}",
    "nudenet_covered": "NudeNet covered={}",
    "nsfwjs": "NSFWJS nsfw={}",
    "symbol_detected": "YOLO forbidden symbol detectedNOTE confidence={}",
    "symbol_possible": "YOLO possible forbidden symbolNOTE confidence={}",
    "firearm_realistic": "YOLO firearm realistic={}",
    "firearm_like": "YOLO firearm-like (toy/uncertain)={}",
    "knife_dangerous": "YOLO dangerous knife={}",
    "knife": "YOLO knife={}",
    "se_nudity_raw": "Sightengine raw nudity={}",
    "se_nudity_partial": "Sightengine partial nudity={}",
    "se_firearm_any": "Sightengine firearm(any)={} (toy={}, gesture={}, animated={})",
    "se_firearm": "Sightengine firearm: realistic={} (firearm={}, toy={}, gesture={}, animated={})",
    "se_violence": "Sightengine violence: prob={} physical={} firearm_threat={}",
    "se_gore": "Sightengine gore/blood: score={} (prob={})",
    "se_offensive": "Sightengine offensive symbols: score={}",
    "se_knife": "Sightengine knife: score={} ctx={}",
    "blocklist_distance": "Blocklist match (distance=NOTE)",
    "allowlist_distance": "Allowlist match (distance=NOTE)",
    "loader_failure": "loader_failure: NOTE",
    "borderline": "Borderline content detected by one or more engines.",
}


def word_reason(code: str, note: str | None, args: Iterable[float]) -> str:
    text = WORDING.get(code, code).format(*[f"{x:.2f}" for x in args])
    if code in ("allowlist_match", "blocklist_match"):
        return text + (f" ({note})" if note else "")
    if code in ("symbol_detected", "symbol_possible"):
        return text.replace("NOTE", f": {note.strip()}" if note and note.strip() else "")
    return text.replace("NOTE", note or "")


@F.pandas_udf(T.ArrayType(T.StringType()))
def reason_texts(reasons: pd.Series) -> pd.Series:
    """Reasons in words, for reports. Rounding is that of C's printf, which no JVM formatter matches on ties."""
    return reasons.map(lambda rs: [word_reason(r["code"], r["note"], r["args"]) for r in rs])
