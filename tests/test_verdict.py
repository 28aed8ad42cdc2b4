"""The rule table against cases worked out by hand from the description of the rules."""

import pytest

from mediasift.operators.verdict import Settings, fold, word_reason

SCHEMA = "media_id string, engine string, engine_ord int, status string, scores map<string,double>, details map<string,string>"


def ok(engine, details=None, **scores):
    return engine, "ok", {k.replace("__", "/"): float(v) for k, v in scores.items()}, details


ERROR = ("OCR text", "error", None, None)
SE, SYMBOLS, WEAPONS, REMOTE = "Sightengine", "YOLO forbidden symbols", "YOLO-World weapons", "OpenAI Moderation"
NONE, ALL = (0.0, 0.0, 0.0), (1.0, 1.0, 1.0)

#: Settings, engine results, and the label, risks (None: any) and reasons that follow.
CASES = {
    "a block match settles and keeps earlier reasons": ({}, [ok("NudeNet", nudity_exposed=0.5), ok("pHash blocklist", {"match_label": "x"}, phash_block_match=1), ok("OCR text", ocr_match=1)], "BLOCK", ALL, ["nudenet_exposed", "blocklist_match"]),
    "an allow match settles before a later text match": ({}, [ok("pHash allowlist", phash_allow_match=1), ok("OCR text", ocr_match=1)], "OK", NONE, ["allowlist_match"]),
    "the limit for minors is strict": ({}, [ok(REMOTE, sexual__minors=0.01)], "OK", NONE, []),
    "above the limit for minors": ({}, [ok(REMOTE, sexual__minors=0.0101)], "BLOCK", ALL, ["minors"]),
    "symbol at the block limit": ({}, [ok(SYMBOLS, {"top_label": "t"}, forbidden_symbols_max_conf=0.90)], "BLOCK", (0, 0, 1.0), ["symbol_detected"]),
    "symbol to review": ({}, [ok(SYMBOLS, forbidden_symbols_max_conf=0.72)], "REVIEW", (0, 0, 0.4), ["symbol_possible"]),
    "symbol at the review limit": ({}, [ok(SYMBOLS, forbidden_symbols_max_conf=0.30)], "REVIEW", (0, 0, 0.4), ["symbol_possible"]),
    "faint symbol": ({}, [ok(SYMBOLS, forbidden_symbols_max_conf=0.10)], "OK", NONE, []),
    "covered raises the risk without a reason": ({}, [ok("NudeNet", nudity_covered=0.9)], "REVIEW", (0.45, 0, 0), ["borderline"]),
    "realistic and firearm-like both speak": ({}, [ok(WEAPONS, yolo_firearm_realistic=0.5, yolo_firearm=0.5)], "BLOCK", (0, 1.0, 0), ["firearm_realistic", "firearm_like"]),
    "toys allowed": ({"allow_toy": True}, [ok(WEAPONS, yolo_firearm_realistic=0.5, yolo_firearm=0.5)], "BLOCK", (0, 1.0, 0), ["firearm_realistic"]),
    "a toy lowers a firearm": ({}, [ok(SE, weapon_firearm=0.9, weapon_firearm_toy=0.8)], "OK", NONE, []),
    "any firearm": ({"se_block_any_firearm": True}, [ok(SE, weapon_firearm=0.9, weapon_firearm_toy=0.8)], "BLOCK", (0, 1.0, 0), ["se_firearm_any"]),
    "a knife needs context": ({}, [ok(SE, weapon_knife=0.7)], "OK", NONE, []),
    "a knife with context": ({}, [ok(SE, weapon_knife=0.7, violence_prob=0.25)], "BLOCK", (0, 1.0, 0), ["se_knife"]),
    "partial nudity is capped by safe": ({}, [ok(SE, nudity_partial=0.9, nudity_safe=0.5)], "OK", (0.3, 0, 0), []),
    "core error to review": ({}, [ERROR, ok("OpenNSFW2", nsfw_probability=0)], "REVIEW", (0.4,) * 3, ["core_failed"]),
    "core error blocks": ({"error_policy": "block"}, [ERROR, ok("OpenNSFW2", nsfw_probability=0)], "BLOCK", (0.5,) * 3, ["core_failed"]),
    "core error ignored": ({"error_policy": "ignore"}, [ERROR, ok("OpenNSFW2", nsfw_probability=0)], "OK", NONE, ["core_failed"]),
    "other errors are only told": ({}, [("NudeNet", "ERROR", None, None), ok("OCR text")], "OK", NONE, ["other_failed"]),
    "nothing ran": ({}, [("OCR text", "skipped", None, None)], "REVIEW", NONE, ["no_checks_ran"]),
    "nothing ran, blocked": ({"no_checks_policy": "block"}, [("OCR text", "skipped", None, None)], "BLOCK", NONE, ["no_checks_ran"]),
    "only an ignored error": ({"error_policy": "ignore"}, [ERROR], "REVIEW", NONE, ["core_failed", "no_checks_ran"]),
    "an engine known by its prefix": ({}, [ok("NSFWJS v2", nsfw_combined=0.6)], "REVIEW", (0.6, 0, 0), ["nsfwjs"]),
    "not a number": ({}, [ok("OpenNSFW2", nsfw_probability=float("nan"))], "OK", NONE, []),
    "above one": ({}, [ok("OpenNSFW2", nsfw_probability=9)], "BLOCK", (1.0, 0, 0), ["opennsfw2"]),
}


@pytest.fixture(scope="module")
def verdicts(spark):
    out = {}
    for settings in {tuple(sorted(c[0].items())) for c in CASES.values()}:
        rows = [(name, e, i, status, scores, details) for name, (given, results, *_) in CASES.items() if tuple(sorted(given.items())) == settings for i, (e, status, scores, details) in enumerate(results)]
        out |= {r["media_id"]: r for r in fold(spark.createDataFrame(rows, SCHEMA), Settings(**dict(settings))).collect()}
    return out


@pytest.mark.parametrize("name", CASES)
def test_case(verdicts, name):
    _, _, label, risks, reasons = CASES[name]
    got = verdicts[name]
    assert (got["label"], [r["code"] for r in got["reasons"]]) == (label, reasons)
    assert (got["nudity_risk"], got["violence_risk"], got["hate_risk"]) == pytest.approx(risks)


def test_wording_rounds_like_printf():
    assert word_reason("opennsfw2", None, [0.125]) == "OpenNSFW2 NSFW=0.12"
    assert word_reason("symbol_detected", "s", [0.93]) == "YOLO forbidden symbol detected: s confidence=0.93"
    assert word_reason("blocklist_match", None, []) == "pHash blocklist match"
