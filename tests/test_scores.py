"""Scores of nested responses against a plain reading of each body."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mediasift.operators.scores import EXPLICIT, MODEL_NAMES, NEUTRAL, SUGGESTIVE, flattened


def _is_number(x: object) -> bool:
    return isinstance(x, (int, float))


def _numbers(d: object):
    if isinstance(d, dict):
        yield from ((k, float(v)) for k, v in d.items() if _is_number(v))


def _deep_max(node: object) -> float:
    """The largest number below node, not counting neutral names; 0 if none."""
    if isinstance(node, list):
        return max(map(_deep_max, (x for x in node if isinstance(x, (dict, list)))), default=0.0)
    if not isinstance(node, dict):
        return 0.0
    open_names = [v for k, v in node.items() if str(k).strip().lower() not in NEUTRAL]
    return max([0.0, *(float(v) if _is_number(v) else _deep_max(v) for v in open_names)])


# (kind of model, place below it, names taken or None for all, prefix of the score); later rules overwrite
RULES = (
    ("weapon", ("classes",), None, "weapon_"),
    ("weapon", (), ("firearm", "knife", "firearm_toy", "firearm_gesture"), "weapon_"),
    ("weapon", ("firearm_type",), None, "weapon_firearm_type_"),
    ("weapon", ("firearm_action", "firearm_gesture"), None, "weapon_firearm_action_"),
    *(rule for kind in ("gore", "violence", "offensive") for rule in ((kind, (), ("prob",), f"{kind}_"), (kind, ("classes",), None, f"{kind}_"), (kind, (), "rest", f"{kind}_"))),
)


def _nudity(model: dict) -> dict[str, float]:
    """The three nudity scores: as given, or worked out of a graded model."""
    given = {f"nudity_{k}": v for k, v in _numbers(model) if k in ("raw", "partial", "safe")}
    if given:
        return given
    graded = {"none": 0.0, "safe": 0.0} | dict(_numbers(model))
    safe, explicit, hints = (min(1.0, max(0.0, *(graded.get(k, 0.0) for k in names))) for names in (("none" if "none" in model else "safe",), EXPLICIT, SUGGESTIVE))
    partial = max(hints, min(1.0, _deep_max(model.get("suggestive_classes"))))
    return {"nudity_safe": safe, "nudity_raw": explicit, "nudity_partial": min(partial, 1 - safe) if safe > 0 else partial}


def flatten_response(body: str | None) -> dict[str, float]:
    """Scores of one nested response, by flat names; unreadable bodies give none."""
    try:
        data = json.loads(body or "")
    except ValueError:
        return {}
    if not isinstance(data, dict):
        return {}
    model = {kind: next((data[n] for n in names if n in data), None) for kind, names in MODEL_NAMES.items()}
    out = {"operations_used": float(data["operations"])} if _is_number(data.get("operations")) else {}
    out |= _nudity(model["nudity"]) if isinstance(model["nudity"], dict) else {}
    for kind, name in (("gore", "gore_prob"), ("violence", "violence_prob"), ("offensive", "offensive_max")):
        if _is_number(model[kind]):
            out[name] = float(model[kind])
    offensive = []
    for kind, places, names, prefix in RULES:
        if isinstance(model[kind], dict):
            node = next((model[kind][p] for p in places if model[kind].get(p)), None) if places else model[kind]
            found = [(k, v) for k, v in _numbers(node) if names is None or (k not in ("prob", "classes") if names == "rest" else k in names)]
            out |= {prefix + k: v for k, v in found if places or k != "classes"}
            offensive += [v for k, v in found if kind == "offensive" and (places or k != "classes")]
    return out | ({"offensive_max": max(offensive)} if offensive else {})


@pytest.fixture(scope="module")
def flat(spark):
    def run(bodies):
        rows = spark.createDataFrame(list(enumerate(bodies)), "n long, body string").repartition(2)
        return [r["s"] for r in flattened(rows, "body", "s").orderBy("n").collect()]

    return run


def test_cases(flat):
    cases = {
        "{": {}, "[1]": {}, "": {}, "null": {}, "{}": {}, '{"nudity": 1, "weapon": [2], "gore": null}': {},
        '{"nudity-2.1": {"raw": 0.5, "safe": true}}': {"nudity_raw": 0.5, "nudity_safe": 1.0},
        '{"nudity": {"none": 0.75, "suggestive_classes": {"x": [{"neutral": 1, "y": 0.5}]}}}': {"nudity_safe": 0.75, "nudity_raw": 0.0, "nudity_partial": 0.25},
        '{"nudity": {"none": "x", "erotica": 2, "suggestive": 0.5, "suggestive_classes": {"a": [{"b": 0.75, "neutral": 1}]}}}': {"nudity_safe": 0.0, "nudity_raw": 1.0, "nudity_partial": 0.75},
        '{"weapon": {"classes": {"firearm": 0.1}, "firearm": 0.2, "firearm_gesture": {"aim": 0.3}}}': {"weapon_firearm": 0.2, "weapon_firearm_action_aim": 0.3},
        '{"weapons": {"firearm_action": {}, "firearm_gesture": {"aim": 0.3}}}': {"weapon_firearm_action_aim": 0.3},
        '{"weapon": {"firearm_action": "x", "firearm_gesture": {"aim": 0.3}}}': {},
        '{"offensive": 0.5, "gore": {"prob": 0.25, "classes": {"corpse": 0.5}}}': {"offensive_max": 0.5, "gore_prob": 0.25, "gore_corpse": 0.5},
        '{"gore": {"prob": 0.25, "classes": {"prob": 0.5}}}': {"gore_prob": 0.5},
        '{"offensive": {"prob": 0.25, "classes": {"nazi": 0.75, "x": true}, "nazi": 0.5, "middle": "0.9"}}': {"offensive_prob": 0.25, "offensive_nazi": 0.5, "offensive_x": 1.0, "offensive_max": 1.0},
        '{"operations": 3, "violence": 0.125}': {"operations_used": 3.0, "violence_prob": 0.125},
    }
    assert flat([*cases, None]) == [*cases.values(), {}]


def test_deep_nesting(flat):
    node = {"y": 0.875, "neutral": 1}
    for i in range(50):
        node = {"deeper": [node]} if i % 2 else {"a": node, "b": i / 1000, " Covered ": {"z": 1}}
    assert flat([json.dumps({"nudity": {"suggestive_classes": node}})]) == [{"nudity_safe": 0.0, "nudity_raw": 0.0, "nudity_partial": 0.875}]


def test_random_bodies_agree_with_the_plain_reading(flat):
    rng = random.Random(7)
    names = ["raw", "partial", "safe", "none", "erotica", "suggestive", "suggestive_classes", "classes", "prob", "firearm", "knife", "firearm_toy", "firearm_type", "firearm_action", "firearm_gesture", "nazi", "neutral", "Safe ", "x"]

    def value(depth):
        kind = rng.random()
        if kind < 0.4 or depth > 4:
            return rng.choice([0, 1, 2, -1, 0.5, 0.25, 1e-7, 0.1, True, False, None, "0.7", "", 12345678901234567890])
        if kind < 0.5:
            return [value(depth + 1) for _ in range(rng.randint(0, 3))]
        return {rng.choice(names): value(depth + 1) for _ in range(rng.randint(0, 6))}

    bodies = [json.dumps({n: value(0) for n in rng.sample([x for names in MODEL_NAMES.values() for x in names] + ["operations"], rng.randint(0, 8))}) for _ in range(1500)]
    assert flat(bodies) == [flatten_response(b) for b in bodies]


def test_no_python_in_the_plan(spark):
    plan = flattened(spark.range(3).select(F.lit("{}").alias("body")), "body", "s")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
