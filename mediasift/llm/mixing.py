"""Operator 7: mixing sources to target weights by Pfair scheduling.

Each source is laid out in a fixed pseudo-random order and cut into blocks of equal size. Weights are whole
numbers; their sum is the length of a frame of slots, one block a slot. Block k of a source with share s is
released at slot floor(k/s) and due at slot ceil((k+1)/s); earliest deadline first among the released blocks
fills every slot, and at every slot each source has had its share of the slots so far to within less than one
block. The schedule repeats by frames, so a block's slot follows from its number alone and no task walks the
blocks. When a source runs out, the others go on with their weights in a new frame; no row is dropped or
repeated.

The schedule is worked out on the driver from one number a source; it holds a frame of slots for each time a source
runs out, so sources should be hundreds, thousands at most, however many rows they have. Tempered weights are shares of
FRAME slots: sources of less than half a slot get a whole one, with a warning.

Ties: rows of a source that are equal in doc_id and size are interchangeable; equal deadlines go to the source first
in alphabetical order.

Edge cases: null source is a source of its own; null and empty texts count one byte; a source without a given
weight gets the least given weight (weights below 1 are refused); repeated rows are scheduled once each; an
empty table gives no rows; all columns are kept, and block, slot and offset are added (replacing columns of
these names). A document longer than a block fills the slots of as many blocks.
"""

from __future__ import annotations

import heapq
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediasift.llm.common import prefix_sums

BLOCK_BYTES, FRAME, TEMPER = 1 << 16, 1000, 0.7
#: Whole rows pass through the sums of a source, so its buckets are small.
ROWS_A_BUCKET = 8_000
#: Schedules of so many sources may be broadcast.
BROADCAST_SOURCES = 1000
ADDED = ("block", "slot", "offset")

PHASE = T.StructType([T.StructField(n, t) for n, t in (("first", T.LongType()), ("base", T.LongType()), ("weight", T.LongType()), ("frame", T.LongType()), ("slots", T.ArrayType(T.LongType())))])
SCHEDULE = T.StructType([T.StructField("_source", T.StringType()), T.StructField("_phases", T.ArrayType(PHASE))])


def frame_slots(weights: dict[str | None, int]) -> dict[str | None, list[int]]:
    """Slots of each source in one frame of sum(weights) slots, earliest deadline first."""
    length = sum(weights.values())
    order = sorted(weights, key=lambda s: (s is None, s))
    waiting = [(0, i, 0) for i in range(len(order))]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out: dict[str | None, list[int]] = {s: [] for s in order}
    for t in range(length):
        while waiting and waiting[0][0] <= t:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * length // weights[order[i]]), i, k))
        _, i, k = heapq.heappop(ready)
        out[order[i]].append(t)
        if k + 1 < weights[order[i]]:
            heapq.heappush(waiting, ((k + 1) * length // weights[order[i]], i, k + 1))
    return out


def phases(blocks: dict[str | None, int], weights: dict[str | None, int]) -> dict[str | None, list[tuple[int, int, int, int, list[int]]]]:
    """For each source its phases (first block, first slot, weight, frame, slots): one phase until each source that runs out."""
    left = {s: n for s, n in blocks.items() if n > 0}
    out: dict[str | None, list] = {s: [] for s in left}
    base = 0
    while left:
        live = {s: weights[s] for s in left}
        length, slots = sum(live.values()), frame_slots(live)

        def last_slot(s, n, live=live, length=length, slots=slots) -> int:
            return (n - 1) // live[s] * length + slots[s][(n - 1) % live[s]]

        end = min(last_slot(s, n) for s, n in left.items()) + 1
        for s in list(left):
            out[s].append((blocks[s] - left[s], base, live[s], length, slots[s]))
            left[s] -= end // length * live[s] + sum(x < end % length for x in slots[s])
            if left[s] <= 0:
                del left[s]
        base += end
    return out


def tempered(sizes: dict[str | None, int], frame: int = FRAME, temper: float = TEMPER) -> dict[str | None, int]:
    """Whole weights in proportion to size ** temper, at least 1 each; a warning where that is more than a source's share of the frame."""
    whole = sum(max(n, 1) ** temper for n in sizes.values())
    if sizes and 2 * frame * max(min(sizes.values()), 1) ** temper < whole:
        warnings.warn(f"{len(sizes)} sources share a frame of {frame} slots: the smallest get more than their weight; give weights of your own", stacklevel=3)
    return {s: max(1, round(frame * max(n, 1) ** temper / whole)) for s, n in sizes.items()}


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block_bytes: int = BLOCK_BYTES, added: tuple[str, str, str] = ADDED) -> DataFrame:
    """docs with block (of its source), slot (in the mixture) and offset (bytes of its source before it), or as `added` names them.

    The order of the mixture is slot, then offset. Without weights, sizes are tempered.
    """
    docs = docs.drop(*added)
    names = docs.columns
    size = F.greatest(F.lit(1), F.coalesce(F.octet_length("text"), F.lit(1))).cast("long")
    found = docs.groupBy(F.col("source").cast("string").alias("s")).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows")).collect()  # a row a source
    sizes, rows = {r["s"]: r["bytes"] for r in found}, sum(r["rows"] for r in found)
    if weights is None:
        given = tempered(sizes)
    else:
        if any(int(w) != w or w < 1 for w in weights.values()):
            raise ValueError("weights are whole numbers of at least 1")
        given = {s: int(weights.get(s, min(weights.values(), default=1))) for s in sizes}
    plan = phases({s: -(-n // block_bytes) for s, n in sizes.items()}, given)
    schedule = docs.sparkSession.createDataFrame([("" if s is None else f"={s}", p) for s, p in plan.items()], SCHEDULE)
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    keyed = docs.select(whole.alias("_row"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_of"), F.col("doc_id").alias("_id"), size.alias("_size"))
    placed = prefix_sums(keyed, ["_of"], [F.col("_id"), F.col("_size")], F.col("_size"), "_offset", rows, ROWS_A_BUCKET)
    placed = placed.withColumn("_block", F.floor(F.col("_offset") / block_bytes))
    joined = placed.join(F.broadcast(schedule) if len(plan) <= BROADCAST_SOURCES else schedule.hint("merge"), F.col("_of") == F.col("_source"))
    phase = F.element_at(F.filter("_phases", lambda p: p["first"] <= F.col("_block")), -1)
    joined = joined.withColumn("_phase", phase).withColumn("_k", F.col("_block") - F.col("_phase")["first"])
    turn = F.col("_phase")["slots"][(F.col("_k") % F.col("_phase")["weight"]).cast("int")]
    slot = F.col("_phase")["base"] + F.floor(F.col("_k") / F.col("_phase")["weight"]) * F.col("_phase")["frame"] + turn
    return joined.select(*[F.col("_row")[f"c{i}"].alias(c) for i, c in enumerate(names)], *[value.alias(name) for name, value in zip(added, (F.col("_block"), slot.cast("long"), F.col("_offset")), strict=True)])


def in_order(mixed: DataFrame, added: tuple[str, str, str] = ADDED) -> DataFrame:
    """The mixture's rows in its order, dealt by ranges of slots, without the columns that mix added."""
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(parts, *added[1:]).sortWithinPartitions(*added[1:]).drop(*added)


def written_order(mixed: DataFrame, out: str) -> DataFrame:
    """mixed, read from the Parquet files of `in_order`, with `out` (long), ascending in the mixture's order.

    Files are written in the order of their ranges, so a row's place is the number of its file and its row there.
    """
    file = mixed.metadataColumn("_metadata")
    number = F.shiftleft(F.regexp_extract(file["file_name"], r"part-(\d+)", 1).cast("long"), 44) + F.shiftleft(F.regexp_extract(file["file_name"], r"-c(\d+)", 1).cast("long"), 32)
    return mixed.withColumn(out, number + file["row_index"])
