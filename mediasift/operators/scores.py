"""Score maps: flattening of API responses, merging across frames, selection for display."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that API responses use, and the scores that reports prefer.
NEUTRAL = ("none", "safe", "neutral", "other", "non_suggestive", "normal", "ok", "no_nudity", "non_nudity", "clothed", "fully_clothed", "covered", "not_nude", "nonnude")
MODEL_NAMES = {
    "nudity": ("nudity", "nudity-2.1", "nudity_2_1"),
    "weapon": ("weapon", "weapons"),
    "gore": ("gore", "gore-2.0", "gore_2_0"),
    "violence": ("violence", "violence-2.0", "violence_2_0"),
    "offensive": ("offensive", "offensive-2.0", "offensive_2_0"),
}
EXPLICIT = ("sexual_activity", "sexual_display", "erotica")
SUGGESTIVE = ("very_suggestive", "suggestive", "mildly_suggestive")
CATEGORIES = ("sexual", "sexual/minors", "violence", "violence/graphic", "self-harm", "self-harm/intent", "self-harm/instructions", "hate", "hate/threatening", "harassment", "harassment/threatening", "illicit", "illicit/violent")
SHOWN_SYMBOLS = ("forbidden_symbols_max_conf", "forbidden_symbols_detection_count", "forbidden_symbols_review_hit", "forbidden_symbols_block_hit")
SHOWN_API = ("nudity_safe", "nudity_raw", "nudity_partial", "weapon_firearm", "weapon_firearm_toy", "weapon_knife", "gore_prob", "violence_prob", "offensive_max")


#: Fields of a weapon model that are scores themselves.
WEAPON_FIELDS = ("firearm", "knife", "firearm_toy", "firearm_gesture")
NUMBERS, SCORES = "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE|BOOLEAN)", "map<string,double>"


def _with(value: Column, use) -> Column:
    """use(value), where value is worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _fields(v: Column) -> Column:
    """The fields of an object; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _number(v: Column) -> Column:
    """A number, or a truth value as 1 or 0; null for anything else."""
    return F.when(F.schema_of_variant(v).rlike(NUMBERS), F.try_variant_get(v, "$", "double"))


def _none() -> Column:
    return F.create_map().cast(SCORES)


def _numbers(fields: Column, keep=None) -> Column:
    """The numbers among fields, of the names that keep is true for; empty where there are none."""
    found = F.transform_values(fields, lambda k, v: _number(v) if keep is None else F.when(keep(k), _number(v)))
    return F.coalesce(F.map_filter(found, lambda k, v: v.isNotNull()), _none())


def _overlaid(*maps: Column) -> Column:
    """All maps in one; later ones win."""
    return reduce(lambda a, b: F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x)), maps)


def _named(prefix: str, values: Column) -> Column:
    return F.transform_keys(values, lambda k, v: F.concat(F.lit(prefix), k))


def _single(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.create_map(F.lit(name), value)).otherwise(_none())


def _most(values: Column) -> Column:
    return F.array_max(F.map_values(values))


def _deep_max(node: Column) -> Column:
    """The largest number below node, not counting what stands below neutral names; 0 if none.

    Level by level: a step takes the containers of one level to their numbers and to the containers of the next. A
    container is opened by a bracket, so there are at most as many levels as the text has of these.
    """
    entry = "array<struct<counted:boolean,v:variant>>"

    def children(v: Column) -> Column:
        own = F.transform(F.filter(F.map_entries(_fields(v)), lambda e: ~F.lower(F.trim(e["key"])).isin(*NEUTRAL)), lambda e: F.struct(F.lit(True).alias("counted"), e["value"].alias("v")))
        listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(F.lit(False).alias("counted"), x.alias("v")))
        return F.coalesce(own.cast(entry), listed.cast(entry), F.array().cast(entry))

    def step(state: Column, _: Column) -> Column:
        found = lambda below: F.array_max(F.transform(F.filter(below, lambda e: e["counted"]), lambda e: _number(e["v"])))
        below = F.flatten(F.transform(state["open"], lambda e: children(e["v"])))
        return _with(below, lambda b: F.struct(b.alias("open"), F.greatest(state["best"], found(b)).alias("best")))

    levels = F.sequence(F.lit(0), F.length(F.regexp_replace(F.to_json(node), r"[^\[{]", "")))
    begin = F.struct(F.array(F.struct(F.lit(False).alias("counted"), node.alias("v"))).cast(entry).alias("open"), F.lit(0.0).alias("best"))
    return F.when(node.isNull(), 0.0).otherwise(F.aggregate(levels, begin, step, lambda a: a["best"]))


def _nudity(model: Column) -> Column:
    """The three nudity scores: as given, or worked out of a graded model."""
    within = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))

    def worked(graded: Column) -> Column:
        value = lambda name: F.coalesce(F.try_element_at(graded, F.lit(name)), F.lit(0.0))
        safe = within(F.when(F.map_contains_key(model, "none"), value("none")).otherwise(value("safe")))
        explicit, hints = (within(F.greatest(*map(value, names))) for names in (EXPLICIT, SUGGESTIVE))
        partial = F.greatest(hints, within(_with(F.try_element_at(model, F.lit("suggestive_classes")), _deep_max)))
        capped = lambda p: F.when(p["safe"] > 0, F.least(p["partial"], 1 - p["safe"])).otherwise(p["partial"])
        return _with(F.struct(safe.alias("safe"), explicit.alias("raw"), partial.alias("partial")), lambda p: F.create_map(F.lit("nudity_safe"), p["safe"], F.lit("nudity_raw"), p["raw"], F.lit("nudity_partial"), capped(p)))

    given = _numbers(model, lambda k: k.isin("raw", "partial", "safe"))
    return F.when(model.isNull(), _none()).otherwise(_with(given, lambda g: F.when(F.size(g) > 0, _named("nudity_", g)).otherwise(_with(_numbers(model), worked))))


def _truthy(v: Column) -> Column:
    """Whether v is there and not empty, zero or false."""
    listed, number = F.try_variant_get(v, "$", "array<variant>"), _number(v)
    return F.when(v.isNull() | F.is_variant_null(v), False).when(_fields(v).isNotNull(), F.size(_fields(v)) > 0).when(listed.isNotNull(), F.size(listed) > 0).when(number.isNotNull(), number != 0).otherwise(F.try_variant_get(v, "$", "string") != "")


def _field(fields: Column, name: str) -> Column:
    return F.try_element_at(fields, F.lit(name))


def _weapon(fields: Column) -> Column:
    acted = _with(_field(fields, "firearm_action"), lambda a: F.when(_truthy(a), a).otherwise(_field(fields, "firearm_gesture")))
    direct = [_named("weapon_", _numbers(_fields(_field(fields, "classes")))), _named("weapon_", _numbers(fields, lambda k: k.isin(*WEAPON_FIELDS)))]
    return _overlaid(*direct, _named("weapon_firearm_type_", _numbers(_fields(_field(fields, "firearm_type")))), _named("weapon_firearm_action_", _numbers(_fields(acted))))


def _levels(fields: Column) -> list[Column]:
    """Numbers of a model by classes: its own, those of its classes, and those beside them; later ones win."""
    return [_numbers(fields, lambda k: k == "prob"), _numbers(_fields(_field(fields, "classes"))), _numbers(fields, lambda k: ~k.isin("prob", "classes"))]


def _classed(kind: str, whole: Column) -> Column:
    single = _single("offensive_max" if kind == "offensive" else f"{kind}_prob", _number(whole))

    def scored(levels: Column) -> Column:
        named = _named(f"{kind}_", _overlaid(*[levels[i] for i in range(3)]))
        return _overlaid(named, _single("offensive_max", F.greatest(*[_most(levels[i]) for i in range(3)]))) if kind == "offensive" else named

    return _with(_fields(whole), lambda f: F.when(f.isNull(), single).otherwise(_with(F.array(*_levels(f)), scored)))


def flat_scores(body: Column) -> Column:
    """Scores of one nested response (JSON text), by flat names; unreadable bodies give none.

    Numbers that JSON doesn't know, and objects with a name twice, make a body unreadable.
    """

    def model(data: Column, kind: str) -> Column:
        return reduce(lambda found, n: F.when(F.map_contains_key(data, n), _field(data, n)).otherwise(found), reversed(MODEL_NAMES[kind]), F.lit(None).cast("variant"))

    def scored(data: Column) -> Column:
        parts = [_single("operations_used", _number(_field(data, "operations"))), _with(_fields(model(data, "nudity")), _nudity), _with(_fields(model(data, "weapon")), _weapon)]
        parts += [_with(model(data, kind), partial(_classed, kind)) for kind in ("gore", "violence", "offensive")]
        return F.concat(*map(F.map_entries, parts))

    return _with(_fields(F.try_parse_json(body)), lambda data: F.when(data.isNull(), _none()).otherwise(F.map_from_entries(scored(data))))


def flattened(responses: DataFrame, body: str, out: str) -> DataFrame:
    """responses with the scores of their bodies.

    An array of one, opened again, keeps the optimizer from copying the extraction into every column that reads it.
    """
    return responses.select("*", F.explode(F.array(flat_scores(F.col(body)))).alias(out))


def category_scores(body: Column) -> Column:
    """Scores of a moderation response: the 13 categories, the highest of them, and the flag."""
    first = lambda path: F.get_json_object(body, f"$.results[0].{path}")
    values = [F.coalesce(first(f"category_scores['{c}']").try_cast("double"), F.lit(0.0)) for c in CATEGORIES]
    pairs = [x for c, v in zip(CATEGORIES, values, strict=True) for x in (F.lit(c), v)]
    flagged = F.when(F.lower(F.coalesce(first("flagged"), F.lit("false"))).isin("true", "1"), 1.0).otherwise(0.0)
    return F.create_map(*pairs, F.lit("max_any_category"), F.greatest(*values), F.lit("flagged"), flagged)


def merge_scores(frames: DataFrame, media: str, scores: str) -> DataFrame:
    """The highest value of each key across the frames of an item; values below 0 count as 0."""
    single = frames.select(media, F.explode(scores).alias("key", "value"))
    best = single.groupBy(media, "key").agg(F.greatest(F.lit(0.0), F.max("value")).alias("value"))
    return best.groupBy(media).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias(scores))


def _has_key(key: str):
    return lambda entry: entry["key"] == key


def shown_scores(engine: str, entries: Column, mode: str = "compact", keys: tuple[str, ...] = (), extra: int = 0, most: int = 8, verbose: bool = False) -> Column:
    """The (key, value) entries of a score array that a report shows, in its order.

    entries is an array of struct(key, value) in the order of the engine; ties of equal values keep that order.
    """
    placed = F.transform(entries, lambda e, i: F.struct((-e["value"]).alias("down"), i.alias("at"), e["key"].alias("key"), e["value"].alias("value")))
    plain = lambda a: F.transform(a, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    ranked = F.array_sort(placed)
    named = lambda wanted: F.flatten(F.array(*[F.filter(entries, _has_key(k)) for k in wanted])) if wanted else F.slice(entries, 1, 0)
    if verbose:
        return entries
    if engine == "YOLO forbidden symbols":
        return named(SHOWN_SYMBOLS)
    if "sightengine" in engine.lower():
        if mode in ("full", "all", "verbose"):
            return entries
        if mode == "keys":
            return named(keys)
        rest = F.filter(ranked, lambda e: ~e["key"].isin(*SHOWN_API))
        return F.concat(named(SHOWN_API), plain(F.filter(F.slice(rest, 1, extra), lambda e: e["value"] >= 0.05))) if extra > 0 else named(SHOWN_API)
    return plain(F.slice(ranked, 1, most))
