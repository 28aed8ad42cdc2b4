"""Hash lists: exact and nearest matching, inserting, and the verdict that a match settles."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasift.scratch import materialise

#: Rows (entries, or entries by their keys) that may be broadcast: some 20 MB. Longer lists are shuffled.
BROADCAST_ROWS = 200_000
#: Hashes and entries of one task where all of them must be compared.
BLOCK_ROWS = 20_000
#: Keys that a task makes of its hashes or entries.
KEY_ROWS = 1_000_000
#: Hashes look for entries within this radius by keys before all that found none are compared with the whole list.
FIRST_RADIUS = 6
#: Comparisons at once, few enough to stay in a core's cache.
CELLS = 1 << 17


def last_entries(entries: DataFrame) -> DataFrame:
    """entries (line_no, bits, label) with the last line of each hash."""
    return entries.groupBy("bits").agg(F.max_by("label", "line_no").alias("label"), F.max("line_no").alias("line_no"))


def exact_match(hashes: DataFrame, entries: DataFrame) -> DataFrame:
    """Left join on equal hashes: match_label and match_line of the entry, null where none."""
    found = last_entries(entries).select(F.col("bits"), F.col("label").alias("match_label"), F.col("line_no").alias("match_line"))
    return hashes.join(found, "bits", "left")


def _cuts(radius: int, together: int) -> list[int]:
    """Masks of bits: hashes that differ in at most radius bits agree under one of them.

    Of radius + together equal bands of bits, that many bits leave `together` bands untouched.
    """
    bands = radius + together
    edges = [round(64 * i / bands) for i in range(bands + 1)]
    parts = [((1 << high) - 1) ^ ((1 << low) - 1) for low, high in zip(edges[:-1], edges[1:], strict=True)]
    masks = [sum(chosen) for chosen in combinations(parts, together)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _width(radius: int, together: int) -> float:
    return 64 * together / (radius + together)


def plan_keys(radius: int, entries: int) -> int:
    """How many bands make a key, so that keys and expected candidates of a hash are fewest; 0: comparing all is less."""
    most = [k for k in range(1, 6) if radius + k <= 64]
    cost = {k: comb(radius + k, k) * (1 + entries / 2 ** _width(radius, k)) for k in most}
    best = min(cost, key=cost.__getitem__, default=0)
    return best if best and cost[best] < max(entries, 64) else 0


def near_pairs(hashes: DataFrame, entries: DataFrame, radius: int, together: int | None = None, broadcast_rows: int = BROADCAST_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(bits, entry_bits, distance) once for every two hashes of both sides that differ in at most radius bits.

    Distinct hashes meet, however many rows they have. Candidates come from an equi-join on masked bits (`_cuts`) and are
    checked exactly; a pair that agrees under several masks counts at the first one. Where a radius is so wide that keys
    would save nothing, hashes and entries meet in blocks. The side of the entries is broadcast only if its
    counted rows are few (Spark's own estimate leaves out the keys that a row is multiplied by); all ways are exact at every size.
    """
    hashes = hashes.select("bits").filter("bits is not null").distinct()
    entries = entries.select(F.col("bits").alias("entry_bits")).filter("entry_bits is not null").distinct()
    n = entries.count()
    together = plan_keys(radius, n) if together is None else together
    differ = F.col("bits").bitwiseXOR(F.col("entry_bits"))
    near = F.bit_count(differ) <= radius
    if together:
        masks = _cuts(radius, together)
        cut = lambda bits: F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(bits).bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)])).alias("_cut")
        dealt = max(1, n * len(masks) // KEY_ROWS)
        few = n * len(masks) <= broadcast_rows
        keyed = entries if few else entries.repartition(dealt, "entry_bits")
        keyed = keyed.select("entry_bits", cut("entry_bits"))
        first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, i) for i, m in enumerate(masks)])
        mine = hashes if few else hashes.repartition(dealt, "bits")
        pairs = mine.select("bits", cut("bits")).join(F.broadcast(keyed) if few else keyed.hint("merge"), "_cut").filter(near).filter(first == F.col("_cut.i"))
    elif n <= broadcast_rows:
        pairs = hashes.join(F.broadcast(entries), near)
    else:
        rows, columns = -(-hashes.count() // block_rows) or 1, -(-n // block_rows)
        turn = lambda k: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")))
        mine = hashes.select("bits", F.pmod(F.xxhash64("bits"), F.lit(rows)).alias("_r"), turn(columns).alias("_c"))
        theirs = entries.select("entry_bits", F.pmod(F.xxhash64("entry_bits"), F.lit(columns)).alias("_c"), turn(rows).alias("_r"))
        pairs = mine.join(theirs.hint("merge"), ["_r", "_c"]).filter(near)
    return pairs.select("bits", "entry_bits", F.bit_count(differ).alias("distance"))


MATCH = ("distance", "match_line", "match_label", "match_bits")


def _nearest_in_block(mine: pa.Table, theirs: pa.Table, radius: int) -> pa.Table:
    """bits, entry_bits, distance: the nearest of theirs (entry_bits, line_no, label) within radius of each of mine (bits); the first line wins ties."""
    order = pc.sort_indices(theirs, sort_keys=[(c, "ascending") for c in ("line_no", "label", "entry_bits")], null_placement="at_start")
    bits, others = mine.column("bits").to_numpy(), theirs.column("entry_bits").take(order).to_numpy()
    at, best = np.zeros(len(bits), np.int64), np.full(len(bits), 65, np.int32)
    step = max(1, CELLS // max(len(others), 1))
    for i in range(0, len(bits) if len(others) else 0, step):
        differ = np.bitwise_count((bits[i : i + step, None] ^ others[None, :]).view(np.uint64))
        at[i : i + step] = differ.argmin(axis=1)
        best[i : i + step] = differ.min(axis=1)
    near = (best <= radius) & (best <= 64)
    return pa.table({"bits": bits[near], "entry_bits": others[at[near]], "distance": best[near]})


def _nearest_by_blocks(hashes: DataFrame, lines: DataFrame, n: int, radius: int, block_rows: int) -> DataFrame:
    """(bits, entry_bits, distance) of the nearest of lines (entry_bits, _line), counted as n, in each block of them."""
    rows, columns = -(-hashes.count() // block_rows) or 1, -(-n // block_rows) or 1
    turn = lambda k: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")))
    mine = hashes.select("bits", F.pmod(F.xxhash64("bits"), F.lit(rows)).alias("_r"), turn(columns).alias("_c"))
    theirs = lines.select("entry_bits", "_line.line_no", "_line.label", F.pmod(F.xxhash64("entry_bits"), F.lit(columns)).alias("_c"), turn(rows).alias("_r"))
    blocks = lambda side: side.repartition(rows * columns, "_r", "_c").groupBy("_r", "_c")
    return blocks(mine).cogroup(blocks(theirs)).applyInArrow(lambda m, t: _nearest_in_block(m, t, radius), "bits long, entry_bits long, distance int")


def _nearest(hashes: DataFrame, entries: DataFrame, radius: int, key: str, together: int | None = None, broadcast_rows: int = BROADCAST_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key and MATCH of the nearest entry within radius; distinct hashes are matched, and each one's entry goes to all its rows.

    Where near_pairs would compare all, most pairs lie within a wide radius, so they never become rows: each block yields
    its nearest entry of a hash. On a list of several blocks, hashes that have an entry within FIRST_RADIUS find it by keys; no
    other entry can be nearer, and only the rest are compared.
    """
    lines = entries.filter("bits is not null").groupBy(F.col("bits").alias("entry_bits")).agg(F.min(F.struct("line_no", "label")).alias("_line"))
    match = F.min(F.struct("distance", F.col("_line.line_no").alias("match_line"), F.col("_line.label").alias("match_label"), F.col("entry_bits").alias("match_bits"))).alias("_m")
    best_of = lambda pairs: pairs.join(lines, "entry_bits").groupBy("bits").agg(match)
    n = lines.count()
    keyed = plan_keys(radius, n) if together is None else together
    if keyed:
        best = best_of(near_pairs(hashes, entries, radius, keyed, broadcast_rows, block_rows))
    else:
        rest, first = hashes.select("bits").filter("bits is not null").distinct(), None
        if together is None and n > block_rows and radius > FIRST_RADIUS and plan_keys(FIRST_RADIUS, n):
            first = materialise(best_of(near_pairs(hashes, entries, FIRST_RADIUS, None, broadcast_rows, block_rows)), "near")
            rest = materialise(rest.join(first.select("bits"), "bits", "left_anti"), "far")
        best = best_of(_nearest_by_blocks(rest, lines, n, radius, block_rows))
        best = best if first is None else first.unionByName(best)
    return hashes.select(key, "bits").join(best, "bits").groupBy(key).agg(F.min("_m").alias("_m")).select(key, "_m.*")


def nearest_match(hashes: DataFrame, entries: DataFrame, radius: int, key: str = "media_id", together: int | None = None, broadcast_rows: int = BROADCAST_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The nearest entry within radius of each hash (key, bits); the first line wins ties."""
    return _nearest(hashes, entries, radius, key, together=together, broadcast_rows=broadcast_rows, block_rows=block_rows).drop("match_bits")


def match_of_frames(frames: DataFrame, entries: DataFrame, radius: int, key: str = "media_id") -> DataFrame:
    """key, MATCH and matched_on: the nearest entry to the first or last frame hash (key, first, last); the first frame wins ties.

    A radius of 0 or less asks for equal hashes, of which the last line counts; otherwise the first of the nearest lines.
    """
    side = lambda n, column: frames.select(F.struct(key, F.lit(n).alias("side")).alias("_of"), F.col(column).alias("bits"))
    sides = side(0, "first").unionByName(side(1, "last")).filter("bits is not null")
    if radius > 0:
        near = _nearest(sides, entries, radius, "_of")
    else:
        equal = last_entries(entries).select("bits", F.lit(0).alias("distance"), F.col("line_no").alias("match_line"), F.col("label").alias("match_label"), F.col("bits").alias("match_bits"))
        near = sides.join(equal, "bits").drop("bits")
    best = F.min(F.struct("distance", F.col("_of.side").alias("side"), *MATCH[1:])).alias("b")
    found = near.groupBy(F.col(f"_of.{key}").alias(key)).agg(best)
    return found.select(key, *[F.col(f"b.{c}").alias(c) for c in MATCH], F.when(F.col("b.side") == 0, "first").otherwise("last").alias("matched_on"))


def nearest_of_two(frames: DataFrame, entries: DataFrame, radius: int, key: str = "media_id") -> DataFrame:
    """The nearest entry to the first or last frame hash (key, first, last); the first frame wins ties."""
    return match_of_frames(frames, entries, radius, key).drop("match_bits")


def insert_if_absent(new: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows of new (hex, label) whose hash, in any case, is in neither the list nor an earlier row (by label)."""
    fresh = new.select(F.lower("hex").alias("hex"), "label").groupBy("hex").agg(F.min("label").alias("label"))
    return fresh.join(entries.select(F.lower("hex").alias("hex")).distinct(), "hex", "left_anti")


def settle_by_lists(matches: DataFrame) -> DataFrame:
    """The verdict that hash matches (media_id, blocked, block_distance, allowed, allow_distance) settle, before any other check.

    A block match wins over an allow match; label is null where neither matches.
    """
    label = F.when(F.col("blocked"), "BLOCK").when(F.col("allowed"), "OK")
    risk = F.when(F.col("blocked"), 1.0).when(F.col("allowed"), 0.0)
    return matches.select("media_id", label.alias("label"), risk.alias("risk"), F.when(F.col("blocked"), F.col("block_distance")).when(F.col("allowed"), F.col("allow_distance")).alias("distance"))
