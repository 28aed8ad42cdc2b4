"""The driver's tables read as media: which table stands for which concept, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.functions.columns import pack_bits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, bits, label: the signs of an embedding as a 64-bit hash."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("media_id"), pack_bits(F.transform("embedding", lambda x: x > 0)).alias("bits"), F.col("label").cast("string").alias("label"))


def block_list(hashed: DataFrame) -> DataFrame:
    """Entries that differ from the hash of their own vector in 0 to 8 bits."""
    flip = F.expr("shiftleft(1L, cast(media_id % 9 as int)) - 1")
    return hashed.select(F.col("media_id").alias("line_no"), F.concat(F.lit("b"), "label").alias("label"), F.col("bits").bitwiseXOR(flip).alias("bits"))


def allow_list(hashed: DataFrame) -> DataFrame:
    """Entries that equal the hash of every other vector and miss the rest by one bit."""
    return hashed.select(F.col("media_id").alias("line_no"), F.concat(F.lit("a"), "label").alias("label"), F.col("bits").bitwiseXOR(F.expr("media_id % 2")).alias("bits"))


def turns(hashed: DataFrame) -> DataFrame:
    """turn, first, last, own: vectors in the order of their ids, with twelve bits of their hash, so that many are near each other."""
    first = F.col("bits").bitwiseAND(4095)
    own = F.when(F.col("media_id") % 11 == 0, "BLOCK").when(F.col("media_id") % 11 < 3, "OK").otherwise("REVIEW")
    return hashed.select(F.col("media_id").alias("turn"), first.alias("first"), first.bitwiseXOR(F.col("media_id") % 2).alias("last"), own.alias("own"))


def given_entries(hashed: DataFrame) -> DataFrame:
    """list_kind, bits: hashes two bits off some vectors, and those of others."""
    bits = F.col("bits").bitwiseAND(4095)
    block = hashed.filter("media_id % 97 = 5").select(F.lit("block").alias("list_kind"), bits.bitwiseXOR(F.lit(3).cast("bigint")).alias("bits"))
    return block.unionByName(hashed.filter("media_id % 101 = 7").select(F.lit("allow").alias("list_kind"), bits.alias("bits")))


TURNS_SQL = """
t AS (SELECT row_number() OVER (ORDER BY media_id) AS k, media_id AS turn, bits & 4095 AS f, xor(bits & 4095, media_id % 2) AS l, CASE WHEN media_id % 11 = 0 THEN 'BLOCK' WHEN media_id % 11 < 3 THEN 'OK' ELSE 'REVIEW' END AS own FROM h),
given AS (SELECT coalesce(list(xor(bits & 4095, 3::BIGINT)) FILTER (media_id % 97 = 5), []) AS block, coalesce(list(bits & 4095) FILTER (media_id % 101 = 7), []) AS allow FROM h)
"""

HASHES_SQL = """
u AS (SELECT vec_id AS media_id, label::VARCHAR AS label,
             list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::HUGEINT << (63 - i) ELSE 0 END)) AS v FROM embeddings),
h AS (SELECT media_id, label, (v - CASE WHEN v >= 9223372036854775808 THEN 18446744073709551616 ELSE 0 END)::BIGINT AS bits FROM u),
bl AS (SELECT media_id AS line_no, 'b' || label AS label, xor(bits, ((1::BIGINT << (media_id % 9)::INT) - 1)::BIGINT) AS bits FROM h),
al AS (SELECT media_id AS line_no, 'a' || label AS label, xor(bits, (media_id % 2)::BIGINT) AS bits FROM h)
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, engine, engine_ord, status, took_ms: an event is a run of an engine."""
    e = table(spark, sf_dir, "events")
    state = F.element_at(F.array(*map(F.lit, ("ok", "OK", "skipped", "disabled", "error", "timeout"))), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select(F.col("user_id").alias("media_id"), F.col("event_type").alias("engine"), F.col("event_id").alias("engine_ord"), state.alias("status"), F.col("value").alias("took_ms"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, total_ms, input_ord, label of each user."""
    r = runs(spark, sf_dir)
    whole = F.sum(F.col("took_ms").cast("bigint")) + 7 * F.count("*") - F.lit(100) * (F.col("media_id") % 5)
    kind = F.element_at(F.array(*map(F.lit, ("OK", "BLOCK", "OTHER", ""))), (F.col("media_id") % 4 + 1).cast("int"))
    return r.groupBy("media_id").agg(whole.alias("total_ms"), F.min("engine_ord").alias("input_ord")).withColumn("label", kind)


RUNS_SQL = """
r AS (SELECT user_id AS media_id, event_type AS engine, event_id AS engine_ord,
             ['ok', 'OK', 'skipped', 'disabled', 'error', 'timeout'][(event_id % 6 + 1)::INT] AS status,
             CASE WHEN value IS NULL OR isnan(value) OR isinf(value) OR value < 0 THEN 0 ELSE trunc(value)::BIGINT END AS ms, value FROM events),
it AS (SELECT media_id, (sum(trunc(value)::BIGINT) + 7 * count(*) - 100 * (media_id % 5))::BIGINT AS total_ms, min(engine_ord) AS input_ord,
              ['OK', 'BLOCK', 'OTHER', ''][(media_id % 4 + 1)::INT] AS label FROM r GROUP BY media_id)
"""

#: Scores that each engine produces here; their numbers feed the formula of `score`.
ENGINES: dict[str, tuple[str, ...]] = {
    "pHash blocklist": ("phash_block_match",),
    "pHash allowlist": ("phash_allow_match",),
    "OCR text": ("ocr_match",),
    "NudeNet": ("nudity_exposed", "nudity_covered"),
    "OpenNSFW2": ("nsfw_probability",),
    "YOLO-World weapons": ("yolo_firearm_realistic", "yolo_firearm_toy", "yolo_firearm", "yolo_knife", "yolo_knife_dangerous"),
    "YOLO forbidden symbols": ("forbidden_symbols_max_conf",),
    "OpenAI Moderation": ("sexual", "sexual/minors", "violence", "violence/graphic", "hate", "hate/threatening"),
    "Sightengine": ("nudity_raw", "nudity_partial", "nudity_safe", "weapon_firearm", "weapon_firearm_toy", "weapon_firearm_gesture", "weapon_firearm_type_animated", "violence_prob", "violence_physical_violence", "violence_firearm_threat", "gore_prob", "gore_very_bloody", "gore_corpse", "offensive_max", "weapon_knife"),
}
NUMBER = {name: j for j, name in enumerate(n for names in ENGINES.values() for n in names)}
MATCHES = ("phash_block_match", "phash_allow_match", "ocr_match")


def score(name: str, media: Column) -> Column:
    """A score that binary fractions hold exactly; list and text matches are 0 or 1."""
    j = NUMBER[name]
    k = ((media * ((2 * j + 1) * 7) + j * 13) % 129).cast("double")
    if name in MATCHES:
        return F.when(k < 40, 1.0).otherwise(0.0)
    if name == "sexual/minors":
        return F.when(k < 16, k / 128).otherwise(0.0)
    return F.pow(k / 128, F.lit(4.0))


def score_sql(name: str) -> str:
    j = NUMBER[name]
    k = f"((m * {(2 * j + 1) * 7} + {j * 13}) % 129)::DOUBLE"
    if name in MATCHES:
        return f"CASE WHEN {k} < 40 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    if name == "sexual/minors":
        return f"CASE WHEN {k} < 16 THEN {k} / 128 ELSE 0.0::DOUBLE END"
    return f"pow({k} / 128, 4)"


def results(spark: SparkSession, sf_dir: str, engines: tuple[str, ...] | None = None, errors: bool = True) -> DataFrame:
    """media_id, engine, engine_ord, status, scores, details of every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"))
    rows = []
    for o, (engine, names) in enumerate(ENGINES.items()):
        if engines and engine not in engines:
            continue
        turn = (F.col("media_id") * 3 + o * 5) % 7
        state = F.when(turn < 2, "ok").when((turn == 6) & (F.col("media_id") % 3 == 0) & F.lit(errors), "error").otherwise("skipped")
        scores = F.create_map(*[x for n in names for x in (F.lit(n), score(n, F.col("media_id")))])
        rows.append(F.struct(F.lit(engine).alias("engine"), F.lit(o).alias("engine_ord"), state.alias("status"), scores.alias("scores")))
    details = F.create_map(F.lit("match_label"), F.lit(None).cast("string"))
    return docs.select("media_id", F.explode(F.array(*rows)).alias("r")).select("media_id", "r.*", details.alias("details"))


def _or(parts: list[str]) -> str:
    return "(" + " OR ".join(parts) + ")" if parts else "FALSE"


def verdict_sql(engines: tuple[str, ...] | None = None, errors: bool = True, error_policy: str = "review", no_checks: str = "REVIEW", switched: bool = False) -> str:
    """DuckDB SQL for verdicts over `results`, written rule by rule; switched: toys are allowed, any knife and any firearm alarms."""
    used = [(o, e) for o, e in enumerate(ENGINES) if not engines or e in engines]
    q = lambda n: f'"{n}"'
    scores = ", ".join(f"{score_sql(n)} AS {q(n)}" for _, e in used for n in ENGINES[e])
    states = ", ".join(f"CASE WHEN (m * 3 + {o * 5}) % 7 < 2 THEN 'ok' WHEN (m * 3 + {o * 5}) % 7 = 6 AND m % 3 = 0 AND {str(errors).upper()} THEN 'error' ELSE 'skipped' END AS st{o}" for o, _ in used)
    settle = {
        "pHash blocklist": [("phash_block_match >= 1", "BLOCK", 1.0, "blocklist_match")],
        "pHash allowlist": [("phash_allow_match >= 1", "OK", 0.0, "allowlist_match")],
        "OCR text": [("ocr_match >= 1", "BLOCK", 1.0, "text_blocked")],
        "OpenAI Moderation": [('"sexual/minors" > 0.01', "BLOCK", 1.0, "minors")],
    }
    partial = "(CASE WHEN nudity_safe > 0 THEN least(nudity_partial, greatest(0, 1 - nudity_safe)) ELSE nudity_partial END)"
    real = "(weapon_firearm * (1 - greatest(weapon_firearm_toy, weapon_firearm_gesture, weapon_firearm_type_animated)))"
    fight = "greatest(violence_prob, violence_physical_violence, violence_firearm_threat)"
    gore = "greatest(gore_prob, gore_very_bloody, gore_corpse)"
    knife = f"weapon_knife >= 0.65 AND greatest({fight}, {gore}) >= 0.25"
    one = lambda w: f"CASE WHEN {w} THEN 1.0 ELSE 0.0 END"
    toys = [] if switched else [("(yolo_firearm_toy >= 0.25 OR yolo_firearm >= 0.35)", "firearm_like")]
    knives = [("yolo_knife >= 0.65", "knife")] if switched else []
    any_firearm = [("weapon_firearm >= 0.35", "se_firearm_any")] if switched else []
    if switched:
        knife = "weapon_knife >= 0.65"
    graded = {  # (risk, value, reason where, code)
        "NudeNet": [("nudity", "nudity_exposed", "nudity_exposed >= 0.4", "nudenet_exposed"), ("nudity", "nudity_covered * 0.5", "nudity_covered * 0.5 >= 0.6", "nudenet_covered")],
        "OpenNSFW2": [("nudity", "nsfw_probability", "nsfw_probability >= 0.5", "opennsfw2")],
        "YOLO-World weapons": [(("violence"), one(w), w, c) for w, c in (("yolo_firearm_realistic >= 0.35", "firearm_realistic"), *toys, ("yolo_knife_dangerous >= 0.35", "knife_dangerous"), *knives)],
        "YOLO forbidden symbols": [
            ("hate", one("forbidden_symbols_max_conf >= 0.9"), "forbidden_symbols_max_conf >= 0.9", "symbol_detected"),
            ("hate", "CASE WHEN forbidden_symbols_max_conf < 0.9 AND forbidden_symbols_max_conf >= 0.3 THEN 0.4 ELSE 0.0 END", "forbidden_symbols_max_conf < 0.9 AND forbidden_symbols_max_conf >= 0.3", "symbol_possible"),
        ],
        "OpenAI Moderation": [("nudity", "sexual", "sexual >= 0.5", "openai_sexual"), ("violence", 'greatest(violence, "violence/graphic")', 'greatest(violence, "violence/graphic") >= 0.5', "openai_violence"), ("hate", 'greatest(hate, "hate/threatening")', 'greatest(hate, "hate/threatening") >= 0.5', "openai_hate")],
        "Sightengine": [
            ("nudity", "nudity_raw", "nudity_raw >= 0.3", "se_nudity_raw"),
            ("nudity", f"{partial} * 0.6", f"{partial} * 0.6 >= 0.42", "se_nudity_partial"),
            *[("violence", one(w), w, c) for w, c in (*any_firearm, (f"{real} >= 0.35", "se_firearm"), (f"{fight} >= 0.3", "se_violence"), (f"{gore} >= 0.2", "se_gore"))],
            ("hate", one("offensive_max >= 0.5"), "offensive_max >= 0.5", "se_offensive"),
            ("violence", one(knife), knife, "se_knife"),
        ],
    }
    ends = [(o, w, label, risk, code) for o, e in used for w, label, risk, code in settle.get(e, [])]
    first = "CASE " + " ".join(f"WHEN st{o} = 'ok' AND {w} THEN {o}" for o, w, *_ in ends) + " END" if ends else "NULL::INT"
    end_of = lambda what: "CASE " + " ".join(f"WHEN tord = {o} THEN {what(label, risk, code)}" for o, _, label, risk, code in ends) + " END" if ends else "NULL"
    live = lambda o: f"st{o} = 'ok' AND (tord IS NULL OR {o} < tord)"
    core = ("pHash allowlist", "pHash blocklist", "OCR text", "OpenAI Moderation", "Sightengine", "YOLO forbidden symbols")
    has_core, has_error = _or([f"st{o} = 'error'" for o, e in used if e in core]), _or([f"st{o} = 'error'" for o, _ in used])
    any_ok = _or([f"st{o} = 'ok'" for o, _ in used])
    floor = {"review": "CASE WHEN ce THEN 0.4 ELSE 0.0 END", "block": "CASE WHEN ce THEN 0.5 ELSE 0.0 END"}.get(error_policy, "0.0")
    stop = f"(NOT ok OR ({str(error_policy == 'block').upper()} AND ce))"
    risks = []
    for d in ("nudity", "violence", "hate"):
        values = ["0.0", *[f"CASE WHEN {live(o)} THEN {v} ELSE 0.0 END" for o, e in used for dim, v, *_ in graded.get(e, []) if dim == d]]
        risks.append(f"(CASE WHEN {stop} THEN fl WHEN tord IS NOT NULL THEN {end_of(lambda _, r, __: r)} ELSE greatest(fl, {', '.join(values)}) END)::DOUBLE AS {d}_risk")
    codes = [f"CASE WHEN {live(o)} AND {w} THEN '{c}' END" for o, e in used for _, _, w, c in graded.get(e, [])]
    given = f"concat_ws(',', {', '.join(codes)})" if codes else "''"
    blocked = f"{str(error_policy == 'block').upper()} AND ce"
    return f"""
WITH d AS (SELECT doc_id AS m FROM documents), s AS (SELECT m, {scores}, {states} FROM d),
a AS (SELECT *, {first} AS tord, {has_core} AS ce, {has_error} AS er, {any_ok} AS ok FROM s),
b AS (SELECT *, {floor} AS fl, CASE WHEN ce THEN 'core_failed' WHEN er THEN 'other_failed' END AS fr FROM a),
c AS (SELECT m AS media_id, {', '.join(risks)}, CASE WHEN {blocked} THEN 'BLOCK' WHEN NOT ok THEN '{no_checks}' WHEN tord IS NOT NULL THEN {end_of(lambda lab, _, __: f"'{lab}'")} END AS early,
      CASE WHEN {blocked} THEN coalesce(fr, '') WHEN NOT ok THEN concat_ws(',', fr, 'no_checks_ran')
           ELSE concat_ws(',', fr, nullif({given}, ''), {end_of(lambda _, __, code: f"'{code}'")}) END AS codes FROM b),
e AS (SELECT media_id, nudity_risk, violence_risk, hate_risk, codes,
      coalesce(early, CASE WHEN greatest(nudity_risk, violence_risk, hate_risk) >= 0.85 THEN 'BLOCK' WHEN greatest(nudity_risk, violence_risk, hate_risk) >= 0.4 THEN 'REVIEW' ELSE 'OK' END) AS label FROM c)
SELECT media_id, label, nudity_risk, violence_risk, hate_risk, CASE WHEN codes = '' AND label <> 'OK' THEN 'borderline' ELSE codes END AS reason_codes FROM e
"""
