"""Column expressions for safe numbers, knobs, names, files and geometry. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions of images, spellings of policies and switches, engine names.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".bmp", ".tif", ".tiff")
MIME_OF_EXTENSION = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp", ".gif": "image/gif", ".bmp": "image/bmp", ".tif": "image/tiff", ".tiff": "image/tiff"}
SWITCH_ON = ("1", "true", "yes", "on")
SWITCH_OFF = ("0", "false", "no", "off")
API_ON_REVIEW = ("on_review", "on-review", "onreview", "only-review", "only_review", "when-review", "when_review", "review", "uncertain")
API_NEVER = ("never", "no-api", "no_api", "no-apis", "no_apis", "noapis", "disable", "off", "disabled", "false", "0", "none")
NO_CHECKS_OK = ("ok", "allow", "open")
NO_CHECKS_BLOCK = ("block", "deny", "fail", "fail_closed")
ERRORS_BLOCK = ("block", "not_ok", "fail", "fail_closed", "deny")
ERRORS_IGNORE = ("ignore", "open", "allow", "lenient", "loose")
CORE_ENGINES = ("pHash allowlist", "pHash blocklist", "OCR text", "OpenAI Moderation", "Sightengine", "YOLO forbidden symbols")
CORE_ALIASES = {
    "phash_allowlist": "pHash allowlist",
    "phash_allow": "pHash allowlist",
    "phash_blocklist": "pHash blocklist",
    "phash_block": "pHash blocklist",
    "ocr": "OCR text",
    "openai": "OpenAI Moderation",
    "sightengine": "Sightengine",
    "forbidden_symbols_yolo": "YOLO forbidden symbols",
    "forbidden_symbols": "YOLO forbidden symbols",
    "yolo_forbidden_symbols": "YOLO forbidden symbols",
}


def finite(value: Column) -> Column:
    """value where it is a finite number, else null; strings are parsed."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def clamp01(value: Column, default: float = 0.0) -> Column:
    """value in [0, 1]; null, NaN, infinities and unparsable strings give the default."""
    x = finite(value)
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))).otherwise(F.lit(float(default)))


def safe_ms(value: Column) -> Column:
    """Milliseconds as a non-negative whole number, truncated; anything else is 0."""
    return F.coalesce(F.greatest(F.lit(0).cast("bigint"), finite(value).try_cast("bigint")), F.lit(0).cast("bigint"))


def knob_int(raw: Column, default: int) -> Column:
    """A whole number written like 5, +5 or 5.00; else the default."""
    t = F.trim(raw)
    return F.coalesce(F.when(t.rlike(r"^[+-]?[0-9]+(\.0+)?$"), t.try_cast("double").try_cast("bigint")), F.lit(default).cast("bigint"))


def knob_int_any(raws: list[Column], default: int) -> Column:
    """The first raw value that is defined decides, even if it is no number."""
    return knob_int(F.coalesce(*raws), default)


def knob_bool(raw: Column, default: bool) -> Column:
    t = F.lower(F.trim(raw))
    return F.when(t.isin(*SWITCH_ON), True).when(t.isin(*SWITCH_OFF), False).otherwise(F.lit(default))


def knob_float(raw: Column, default: float, low: float | None = None, high: float | None = None) -> Column:
    x = F.coalesce(finite(F.trim(raw)), F.lit(float(default)))
    x = x if low is None else F.greatest(F.lit(float(low)), x)
    return x if high is None else F.least(F.lit(float(high)), x)


def label_set(raw: Column) -> Column:
    """The distinct lower-cased entries of a comma list, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def status(raw: Column) -> Column:
    return F.lower(raw)


def api_policy(raw: Column) -> Column:
    t = F.lower(F.trim(raw))
    return F.when(t.isin(*API_ON_REVIEW), "on_review").when(t.isin(*API_NEVER), "never").otherwise("always")


def no_checks_policy(raw: Column) -> Column:
    t = F.lower(F.trim(raw))
    return F.when(t.isin(*NO_CHECKS_OK), "ok").when(t.isin(*NO_CHECKS_BLOCK), "block").otherwise("review")


def error_policy(raw: Column) -> Column:
    t = F.lower(F.trim(raw))
    return F.when(t.isin(*ERRORS_BLOCK), "block").when(t.isin(*ERRORS_IGNORE), "ignore").otherwise("review")


def core_engines(raw: Column) -> Column:
    """Names of the core engines: the entries of a comma list by alias, or the built-in set where it is blank."""
    alias = F.create_map(*[F.lit(x) for pair in CORE_ALIASES.items() for x in pair])
    items = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    named = F.array_distinct(F.transform(items, lambda x: F.coalesce(F.try_element_at(alias, F.lower(x)), x)))
    return F.when(F.size(named) > 0, named).otherwise(F.array(*[F.lit(x) for x in CORE_ENGINES]))


def model_list(raw: Column) -> Column:
    """Model names of a comma list or a bracketed, quoted list: cleaned, distinct, in order, comma-joined."""
    bare = F.regexp_replace(F.trim(raw), r"^\[(.*)\]$", "$1")
    clean = F.transform(F.split(bare, ","), lambda x: F.regexp_replace(F.trim(x), r"^[\s\"'\[]+|[\s\"'\]]+$", ""))
    return F.array_join(F.array_distinct(F.filter(clean, lambda x: x != "")), ",")


def extension(path: Column) -> Column:
    """The lower-cased extension with its dot; empty for names without one or that only begin with a dot."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(F.regexp_replace(name, r"^\.+", ""), r"^[^.].*(\.[^.]*)$|^[^.](\.[^.]*)$", 1))


def is_image_path(path: Column) -> Column:
    return extension(path).isin(*IMAGE_EXTENSIONS)


def mime_of_path(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MIME_OF_EXTENSION.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("application/octet-stream"))


def is_url(text: Column) -> Column:
    """http or https with a non-empty authority."""
    return F.coalesce(F.lower(text).rlike(r"^https?://[^/?#]+"), F.lit(False))


def sniff_mime(head: Column) -> Column:
    """Image type by the first bytes of a binary column; empty if unknown."""
    h = F.hex(F.substring(head, 1, 12))
    return (
        F.when(h.startswith("FFD8FF"), "image/jpeg")
        .when(h.startswith("89504E470D0A1A0A"), "image/png")
        .when(h.startswith("474946383761") | h.startswith("474946383961"), "image/gif")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "image/webp")
        .otherwise("")
    )


def fetch_decision(url: Column, content_type: Column, head: Column, length: Column, declared: Column, limit: int = 25_000_000) -> Column:
    """What becomes of a fetched URL: struct(error, ext, name)."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    seen = sniff_mime(head)
    stated = F.when(kind.startswith("image/"), kind).when(seen != "", seen).otherwise(kind)
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    by_type = F.when(stated.isin("image/jpeg", "image/jpg"), ".jpg").when(stated == "image/png", ".png").when(stated == "image/webp", ".webp").when(stated == "image/gif", ".gif")
    by_path = F.when(extension(path).isin(".jpg", ".jpeg"), ".jpg").when(extension(path).isin(".png", ".webp", ".gif"), extension(path))
    by_head = F.when(seen == "image/jpeg", ".jpg").when(seen == "image/png", ".png").when(seen == "image/gif", ".gif").when(seen == "image/webp", ".webp")
    ext = F.coalesce(by_type, by_path, by_head)
    error = (
        F.when(F.coalesce(declared, F.lit(0)) > limit, "too_large")
        .when(length > limit, "too_large")
        .when((kind != "") & ~kind.startswith("image/") & (seen == ""), "not_an_image")
        .when(ext.isNull(), "unsupported_format")
    )
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.struct(error.alias("error"), F.when(error.isNull(), ext).alias("ext"), F.when(error.isNull(), F.when(name != "", name).otherwise(F.concat(F.lit("downloaded"), ext))).alias("name"))


def box_shape(box: Column, width: Column, height: Column) -> Column:
    """Normalised corners and area share of an (x1, y1, x2, y2) box; boxes of fewer numbers are zero."""
    full = F.size(box) >= 4
    w, h = F.greatest(width, F.lit(1)), F.greatest(height, F.lit(1))
    corner = [F.when(full, clamp01(box[i] / (w if i % 2 == 0 else h))).otherwise(F.lit(0.0)) for i in range(4)]
    area = F.greatest(F.lit(0.0), box[2] - box[0]) * F.greatest(F.lit(0.0), box[3] - box[1]) / (w * h)
    return F.struct(F.array(*corner).alias("norm"), F.when(full, clamp01(area)).otherwise(F.lit(0.0)).alias("area_ratio"))


def class_name(class_id: Column, *names: Column) -> Column:
    """The name of a class in the first map that has it, else its number."""
    return F.coalesce(*[F.try_element_at(n, class_id) for n in names], class_id.cast("string"))


def error_class(message: Column, status_code: Column) -> Column:
    """How a remote call failed: struct(code, rate_limited, auth)."""
    found = F.coalesce(status_code, F.regexp_extract(message, r"Error code:\s*(\d{3})", 1).try_cast("int"))
    m = F.lower(message)
    limited = (F.coalesce(status_code, F.lit(0)) == 429) | message.contains("Error code: 429") | message.contains("Too Many Requests") | (m.contains("rate") & m.contains("429"))
    auth = F.coalesce(found.isin(401, 403), F.lit(False)) | m.contains("deactivated") | m.contains("invalid api key") | m.contains("unauthorized")
    return F.struct(found.alias("code"), F.coalesce(limited, F.lit(False)).alias("rate_limited"), F.coalesce(auth, F.lit(False)).alias("auth"))


def retry_after(raw: Column) -> Column:
    """Seconds of a Retry-After value such as 3 or 2.5s; null if unreadable."""
    return finite(F.regexp_replace(F.lower(F.trim(raw)), "s$", ""))


def backoff(attempt: Column, base: float = 1.0, most: float = 10.0) -> Column:
    """Seconds before another attempt, without jitter."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt))


def bits_of_hex(text: Column) -> Column:
    """A hash of 16 hex digits as a signed 64-bit number; null for anything else."""
    return F.when(F.lower(text).rlike("^[0-9a-f]{16}$"), F.conv(text, 16, -10).cast("bigint"))


def hex_of_bits(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pack_bits(flags: Column) -> Column:
    """An array of 64 booleans as a number, first flag highest."""
    return F.aggregate(flags, F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x, 1).otherwise(0).cast("bigint")))
