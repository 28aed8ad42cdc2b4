"""Settings from the environment and from KEY=VALUE files, resolved once on the driver."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from mediasift.functions import columns as names
from mediasift.operators.routing import Learning, Route
from mediasift.operators.verdict import Settings


def parse_line(line: str) -> tuple[str, str] | None:
    """(key, value) of one line; export and set prefixes, quotes and ` #` comments are understood."""
    m = re.match(r"\s*(?:(?:export|set)\s+)?﻿?([^=#][^=]*?)\s*=\s*(.*?)\s*$", line.lstrip("﻿"), re.IGNORECASE)
    if not m:
        return None
    key, value = m[1].strip(), m[2]
    quoted = re.fullmatch(r"\"(.*)\"|'(.*)'", value)
    if quoted:
        return key, quoted[1] if quoted[1] is not None else quoted[2]
    return key, value.split(" #", 1)[0].rstrip()


def read_env_file(path: str | Path, env: Mapping[str, str], override: bool = False) -> dict[str, str]:
    """env with the entries of a file; what is set already stays unless override."""
    out = dict(env)
    p = Path(path)
    if p.exists():
        for line in p.read_text(encoding="utf-8-sig").splitlines():
            found = parse_line(line)
            if found and (override or found[0] not in env):
                out[found[0]] = found[1]
    return out


def load(folder: str | Path = ".", env: Mapping[str, str] | None = None) -> dict[str, str]:
    """The environment with the first of .env, .env.txt and .env.example that exists; the example never overrides."""
    env = dict(os.environ if env is None else env)
    for name in (".env", ".env.txt", ".env.example"):
        if (Path(folder) / name).exists():
            return read_env_file(Path(folder) / name, env, name != ".env.example" and switch(env, "DOTENV_OVERRIDE", False))
    return env


def switch(env: Mapping[str, str], key: str, default: bool) -> bool:
    v = env.get(key, "").strip().lower()
    return True if v in names.SWITCH_ON else False if v in names.SWITCH_OFF else default


def whole(env: Mapping[str, str], key: str, default: int) -> int:
    v = env.get(key, "").strip()
    return int(float(v)) if re.fullmatch(r"[+-]?\d+(\.0+)?", v) else default


def number(env: Mapping[str, str], key: str, default: float) -> float:
    try:
        v = float(env.get(key, "").strip())
    except ValueError:
        return default
    return v if math.isfinite(v) else default


@dataclass(frozen=True)
class Run:
    """All that a run needs to know."""

    settings: Settings
    route: Route
    learning: Learning
    sample_frames: int = 12
    allow_distance: int = 0
    block_distance: int = 6
    ocr_frames: int = 2
    ocr_least: int = 3


def _first(env: Mapping[str, str], keys: tuple[str, ...], default: int) -> int:
    return next((whole(env, k, default) for k in keys if k in env), default)


def resolve(env: Mapping[str, str], no_apis: bool = False) -> Run:
    """Settings of a run from an environment."""
    policy = env.get("API_POLICY", "").strip().lower()
    errors, nothing = env.get("ENGINE_ERROR_POLICY", "review").strip().lower(), env.get("NO_CHECKS_POLICY", "review").strip().lower()
    listed = [x.strip() for x in env.get("CORE_ENGINES", "").split(",") if x.strip()]
    block = number(env, "FINAL_BLOCK_THRESHOLD", 0.85)
    settings = Settings(
        block=min(1.0, max(0.0, block)),
        review=number(env, "FINAL_REVIEW_THRESHOLD", 0.40),
        core=tuple(names.CORE_ALIASES.get(x.lower(), x) for x in listed) or names.CORE_ENGINES,
        error_policy="block" if errors in names.ERRORS_BLOCK else "ignore" if errors in names.ERRORS_IGNORE else "review",
        no_checks_policy="ok" if nothing in names.NO_CHECKS_OK else "block" if nothing in names.NO_CHECKS_BLOCK else "review",
        symbol_block=number(env, "FORBIDDEN_SYMBOLS_YOLO_BLOCK_CONF", 0.90),
        symbol_review=number(env, "FORBIDDEN_SYMBOLS_YOLO_REVIEW_CONF", 0.30),
        firearm=number(env, "YOLO_FIREARM_THRESH", 0.35),
        toy=number(env, "YOLO_FIREARM_TOY_THRESH", 0.25),
        allow_toy=switch(env, "ALLOW_TOY_GUN", False),
        dangerous_knife=number(env, "YOLO_DANGEROUS_KNIFE_THRESH", 0.35),
        knife=number(env, "YOLO_KNIFE_THRESH", 0.65),
        block_all_knives=switch(env, "YOLO_KNIFE_BLOCK_ALL", False),
        se_firearm=number(env, "SE_FIREARM_THRESH", 0.35),
        se_block_any_firearm=switch(env, "SE_BLOCK_ANY_FIREARM", False),
        se_violence=number(env, "SE_VIOLENCE_THRESH", 0.30),
        se_gore=number(env, "SE_GORE_THRESH", 0.20),
        se_offensive=number(env, "SE_OFFENSIVE_THRESH", 0.50),
        se_knife=number(env, "SE_KNIFE_THRESH", 0.65),
        se_block_all_knives=switch(env, "SE_KNIFE_BLOCK_ALL", False),
        se_knife_context=number(env, "SE_KNIFE_CONTEXT_THRESH", 0.25),
    )
    route = Route(switch(env, "SHORT_CIRCUIT_PHASH", True), "on_review" if policy in names.API_ON_REVIEW else "never" if policy in names.API_NEVER else "always", no_apis)
    one = lambda k: None if k not in env or env[k].strip() == "" else env[k].strip() == "1"
    learning = Learning(
        enabled=None if "PHASH_AUTO_LEARN_ENABLE" not in env else env["PHASH_AUTO_LEARN_ENABLE"].strip() == "1",
        append=bool(one("PHASH_AUTO_APPEND")),
        allow=one("PHASH_AUTO_ALLOW_APPEND"),
        block=one("PHASH_AUTO_BLOCK_APPEND"),
        first_and_last=bool(one("PHASH_GIF_LEARN_FIRST_LAST")),
        allow_label=env.get("PHASH_AUTO_ALLOW_LABEL", env.get("PHASH_AUTO_LABEL", "ok")).strip() or "ok",
        block_label=env.get("PHASH_AUTO_BLOCK_LABEL", env.get("PHASH_AUTO_LABEL", "not_ok")).strip() or "not_ok",
    )
    return Run(settings, route, learning, max(1, whole(env, "SAMPLE_FRAMES", 12)), _first(env, ("PHASH_ALLOW_MAX_DISTANCE", "PHASH_ALLOW_MAXDIST"), 0), _first(env, ("PHASH_BLOCK_MAX_DISTANCE", "PHASH_MAXDIST", "PHASH_BLOCK_MAXDIST"), 6), whole(env, "OCR_MAX_FRAMES", 2), whole(env, "OCR_MIN_LEN", 3))
