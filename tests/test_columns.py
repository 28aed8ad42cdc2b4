import random

import pytest
from pyspark.sql import functions as F

from mediasift.functions import columns as c


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("value,want", [(0.5, 0.5), (-1.0, 0.0), (7.0, 1.0), (float("nan"), 0.25), (float("inf"), 0.25), (None, 0.25)])
def test_clamp01(spark, value, want):
    assert one(spark, c.clamp01(F.lit(value).cast("double"), 0.25)) == want


@pytest.mark.parametrize("value,want", [("12", 12), ("12.7", 12), ("-5", 0), ("not-a-number", 0), ("NaN", 0), ("Infinity", 0), (None, 0)])
def test_safe_ms(spark, value, want):
    assert one(spark, c.safe_ms(F.lit(value).cast("string"))) == want


@pytest.mark.parametrize("value,want", [("5", 5), ("+5", 5), ("5.00", 5), ("5.5", 9), ("", 9), (None, 9), ("x", 9), (" 7 ", 7)])
def test_knob_int(spark, value, want):
    assert one(spark, c.knob_int(F.lit(value).cast("string"), 9)) == want


def test_knob_int_any_takes_the_first_defined_even_if_invalid(spark):
    assert one(spark, c.knob_int_any([F.lit(None).cast("string"), F.lit("bad"), F.lit("3")], 6)) == 6


@pytest.mark.parametrize("value,want", [("https://a/b", True), ("HTTPS://a", True), ("http://", False), ("ftp://a", False), ("a.png", False), ("http:///x", False), (None, False)])
def test_is_url(spark, value, want):
    assert one(spark, c.is_url(F.lit(value).cast("string"))) is want


@pytest.mark.parametrize("value,want", [("/a/b.JPG", ".jpg"), ("/a.d/b", ""), ("/a/.png", ""), ("x.tar.gif", ".gif"), ("b.webp", ".webp"), ("a.", "."), ("...png", "")])
def test_extension(spark, value, want):
    assert one(spark, c.extension(F.lit(value))) == want


def test_hex_of_all_bits(spark):
    assert one(spark, c.bits_of_hex(F.lit("FFFFFFFFFFFFFFFF"))) == -1
    assert one(spark, c.hex_of_bits(F.lit(-1).cast("bigint"))) == "f" * 16
    assert one(spark, c.bits_of_hex(F.lit("abc"))) is None
    assert one(spark, c.hamming(F.lit(-1).cast("bigint"), F.lit(0).cast("bigint"))) == 64


def test_box_shape(spark):
    s = one(spark, c.box_shape(F.array(*map(F.lit, (10.0, 20.0, 110.0, 80.0))), F.lit(200), F.lit(100)))
    assert list(s["norm"]) == [0.05, 0.2, 0.55, 0.8] and s["area_ratio"] == pytest.approx(0.3)
    short = one(spark, c.box_shape(F.array(F.lit(1.0)), F.lit(200), F.lit(0)))
    assert list(short["norm"]) == [0, 0, 0, 0] and short["area_ratio"] == 0


@pytest.mark.parametrize("value,want", [("['a', 'b']", "a,b"), ('["x","x", y]', "x,y"), ("nudity-2.1,weapon", "nudity-2.1,weapon"), ("", "")])
def test_model_list(spark, value, want):
    assert one(spark, c.model_list(F.lit(value))) == want


@pytest.mark.parametrize("message,code,limited,auth", [("Error code: 429 x", 429, True, False), ("Error code: 401", 401, False, True), ("boom", None, False, False), ("account deactivated", None, False, True)])
def test_error_class(spark, message, code, limited, auth):
    s = one(spark, c.error_class(F.lit(message), F.lit(None).cast("int")))
    assert (s["code"], s["rate_limited"], s["auth"]) == (code, limited, auth)


@pytest.mark.parametrize("value,want", [("3", 3.0), ("2.5s", 2.5), ("soon", None)])
def test_retry_after(spark, value, want):
    assert one(spark, c.retry_after(F.lit(value))) == want


def test_backoff_is_capped(spark):
    assert [one(spark, c.backoff(F.lit(i))) for i in range(6)] == [1, 2, 4, 8, 10, 10]


def test_nearest_match_agrees_by_every_plan(spark):
    from mediasift.operators.matching import nearest_match, plan_keys

    rng = random.Random(3)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    flipped = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    entries = [rng.getrandbits(64) for _ in range(60)]
    entries += entries[:5]  # equal hashes: the first line wins
    hashes = [flipped(entries[rng.randrange(60)], rng.randrange(0, 30)) for _ in range(80)] + [entries[0]] * 3
    e = spark.createDataFrame([(i, f"l{i}", signed(x)) for i, x in enumerate(entries)], "line_no long, label string, bits long").cache()
    h = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(hashes)], "media_id long, bits long").cache()
    for radius in (0, 6, 24, 64):
        want = {}
        for i, x in enumerate(hashes):
            d, n = min(((x ^ y).bit_count(), n) for n, y in enumerate(entries))
            if d <= radius:
                want[i] = (d, n, f"l{n}")
        for together, most in ((None, 10**6), (None, 0), (1, 0), (2, 10**6), (0, 10**6), (0, 0)):
            if (together or 0) + radius <= 64 and not (together == 2 and radius > 6):
                got = nearest_match(h, e, radius, together=together, broadcast_rows=most, block_rows=16)
                assert {r["media_id"]: (r["distance"], r["match_line"], r["match_label"]) for r in got.collect()} == want
    assert plan_keys(6, 10**8) > plan_keys(6, 100) > 0 == plan_keys(24, 10**4)
    assert not nearest_match(h, e.limit(0), 24).count() and not nearest_match(h.limit(0), e, 24, broadcast_rows=0).count()


def test_a_list_too_long_to_broadcast_is_not_broadcast(spark):
    from mediasift.operators.matching import near_pairs

    h = spark.range(300).select(F.xxhash64("id").alias("bits"))
    got = near_pairs(h, h, 6, together=3, broadcast_rows=0)
    assert got.count() >= 300
    got.collect()  # the plan is final only then
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_wide_radius_makes_no_rows_of_all_near_pairs(spark):
    from mediasift.operators import matching

    bits = spark.range(200).select("id", F.xxhash64("id").alias("bits"))
    e = bits.select(F.col("id").alias("line_no"), F.lit("l").alias("label"), F.col("bits").bitwiseXOR(1 << 40).alias("bits"))
    got = matching.nearest_match(bits.select(F.col("id").alias("media_id"), "bits"), e, 40, together=0, broadcast_rows=0, block_rows=50)
    assert {(r["media_id"], r["distance"], r["match_line"]) for r in got.collect()} == {(i, 1, i) for i in range(200)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "bit_count" not in plan  # blocks yield the nearest; nothing filters pairs that are rows
    lines = e.select(F.col("bits").alias("entry_bits"), F.struct("line_no", "label").alias("_line"))
    assert matching._nearest_by_blocks(bits, lines, 200, 40, 50).count() <= 200 * 4 < 200 * 200 * 0.9
