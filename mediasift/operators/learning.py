"""Learning within a run: inputs are judged one after the other, and a hash learned from one counts for all later ones.

A verdict follows from the lists as they stand when an input's turn comes, so it depends on earlier inputs only. That
makes the run of all inputs the one fixpoint of a step that judges all of them at once: given for every hash the turn
since when it stands on a list, judge every input by the entries near it that are older than it, and learn anew.
Starting from the given lists, inputs whose verdict no earlier undecided one can change are right after one step, those
behind them after the next; the steps end when nothing changes, after as many as the longest chain of inputs that
changed each other's verdict, and one. Pairs of near hashes are found once, between distinct hashes.

A step joins narrow rows (turn, hash, own verdict) with one row a hash. Hashes of many rows are dealt over several
tasks. Inputs without a hash keep their own verdict and are not learned; so do those whose verdict is neither OK nor
BLOCK. An empty list or an empty table of inputs gives what the plain loop would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.operators.matching import near_pairs
from mediasift.operators.routing import Learning, list_verdict
from mediasift.scratch import discard, materialise

#: Rows of a hash that one task joins; a hash with more is dealt over several.
ROWS_A_PART = 100_000
#: The verdict whose hashes go to a list.
LABELS = {"block": "BLOCK", "allow": "OK"}


def _sought(inputs: DataFrame, both: bool) -> DataFrame:
    """turn, own, bits: a row for each different frame hash of an input, or one without."""
    found = F.array_distinct(F.filter(F.array("first", "last"), lambda x: x.isNotNull())) if both else F.filter(F.array("first"), lambda x: x.isNotNull())
    return inputs.select("turn", "own", F.explode_outer(found).alias("bits"))


def _parts(n: Column) -> Column:
    return F.ceil(n / ROWS_A_PART).cast("long")


def learn_in_order(inputs: DataFrame, entries: DataFrame, how: Learning, block_radius: int = 6, allow_radius: int = 0, both: bool = True) -> DataFrame:
    """Verdicts of inputs (turn, first, last, own) judged in the order of turn, which is unique.

    entries: list_kind (block or allow), bits. first and last are hashes of an input's frames, own the verdict that it
    gets where no list settles it; with `both` either frame may match. Returns turn, label, settled_by (block, allow or
    null), distance of the nearest entry then on that list, and learned: whether none of the given entries is as near.
    """
    radius = {"block": block_radius, "allow": allow_radius}
    rows = materialise(_sought(inputs, both), "inputs")
    taught = rows if both == how.first_and_last else materialise(_sought(inputs, how.first_and_last), "taught")
    given = entries.select(F.col("list_kind").alias("kind"), "bits").filter("bits is not null and kind in ('block', 'allow')").distinct().withColumn("since", F.lit(-1).cast("long"))
    given = materialise(given, "given")
    kinds = [k for k, label in LABELS.items() if how.learns(label)]
    sizes = rows.filter("bits is not null").groupBy("bits").agg(_parts(F.count("*")).alias("parts"))
    dealt = materialise(rows.join(sizes, "bits", "left").withColumn("part", F.pmod("turn", F.coalesce("parts", F.lit(1)))), "dealt")
    pairs = []
    for kind in LABELS:
        learnable = taught.select("bits").filter(F.lit(kind in kinds))
        pairs.append(near_pairs(dealt, given.filter(F.col("kind") == kind).select("bits").unionByName(learnable), radius[kind]).withColumn("kind", F.lit(kind)))
    pairs = materialise(pairs[0].unionByName(pairs[1]), "near")
    state, seen = given, _mark(given)
    while True:
        judged = _judge(dealt, pairs, state)
        after = materialise(given.unionByName(_learned(judged, taught, kinds)).groupBy("kind", "bits").agg(F.min("since").alias("since")), "state")
        mark = _mark(after)
        if state is not given:
            discard(state)
        state = after
        if mark == seen:
            return judged.select("turn", "label", "settled_by", "distance", (F.col("since") >= 0).alias("learned"))
        discard(judged)
        seen = mark


def _mark(state: DataFrame) -> tuple:
    """Equal for equal states."""
    return tuple(state.agg(F.count("*"), F.sum(F.xxhash64("kind", "bits", "since").cast("decimal(38,0)"))).first())


def _judge(dealt: DataFrame, pairs: DataFrame, state: DataFrame) -> DataFrame:
    """turn, label, settled_by, distance and since (of the nearest entry) of each input, given since when entries stand."""
    at = pairs.join(state.withColumnRenamed("bits", "entry_bits"), ["kind", "entry_bits"]).groupBy("bits", "kind", "distance").agg(F.min("since").alias("since"))
    # at most a row for each distance up to the radius
    reach = at.groupBy("bits").agg(*[F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("distance", "since")))).alias(k) for k in LABELS])
    split = dealt.filter("bits is not null").select("bits", "parts").distinct()
    reach = reach.join(split, "bits").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    met = dealt.join(reach, ["bits", "part"], "left")
    older = lambda k: F.get(F.filter(k, lambda x: x["since"] < F.col("turn")), F.lit(0))
    whole = met.groupBy("turn").agg(F.first("own").alias("own"), *[F.min(older(k)).alias(k) for k in LABELS])  # one or two rows a turn
    chosen = F.coalesce("block", "allow")
    settled = F.when(F.col("block").isNotNull(), "block").when(F.col("allow").isNotNull(), "allow")
    label = F.when(F.col("block").isNotNull(), LABELS["block"]).when(F.col("allow").isNotNull(), LABELS["allow"]).otherwise(F.col("own"))
    return materialise(whole.select("turn", label.alias("label"), settled.alias("settled_by"), chosen["distance"].alias("distance"), chosen["since"].alias("since")), "judged")


def _learned(judged: DataFrame, taught: DataFrame, kinds: list[str]) -> DataFrame:
    """kind, bits and since (the first turn) of what verdicts add to the lists."""
    kind = F.lit(None).cast("string")
    for k in kinds:
        kind = F.when(F.col("label") == LABELS[k], k).otherwise(kind)
    added = judged.select("turn", kind.alias("kind")).filter("kind is not null").join(taught.filter("bits is not null"), "turn")
    return added.groupBy("kind", "bits").agg(F.min("turn").alias("since"))


def added_entries(inputs: DataFrame, judged: DataFrame, entries: DataFrame, how: Learning) -> DataFrame:
    """list_kind, bits, label and turn of the entries that a run adds, each hash once a list and none that it holds already."""
    kinds = [k for k, label in LABELS.items() if how.learns(label)]
    new = _learned(judged, _sought(inputs, how.first_and_last), kinds).select(F.col("kind").alias("list_kind"), "bits", F.col("since").alias("turn"))
    fresh = new.join(entries.select("list_kind", "bits").distinct(), ["list_kind", "bits"], "left_anti")
    return fresh.withColumn("label", F.when(F.col("list_kind") == "block", how.block_label).otherwise(how.allow_label))


def verdicts_in_order(media: DataFrame, verdicts: DataFrame, entries: DataFrame, how: Learning, block_radius: int = 6, allow_radius: int = 0) -> tuple[DataFrame, DataFrame]:
    """(verdicts, entries that the run adds) of media (media_id, turn, first, last) that are judged one after the other.

    verdicts are those of a run that short-circuits by the given lists (`moderate`): they stand for every input that
    neither a given nor a learned entry settles when its turn comes. Media without a turn keep theirs.
    """
    own = verdicts.select("media_id", F.col("label").alias("own"))
    inputs = materialise(media.filter("turn is not null").join(own, "media_id").select("media_id", "turn", "first", "last", "own"), "turns")
    judged = learn_in_order(inputs, entries, how, block_radius, allow_radius)
    settled = judged.filter("settled_by is not null").join(inputs.select("turn", "media_id"), "turn")
    by_lists = settled.select("media_id", *list_verdict(F.col("settled_by") == "block", F.col("distance").cast("string")))
    return verdicts.join(settled.select("media_id"), "media_id", "left_anti").unionByName(by_lists), added_entries(inputs, judged, entries, how)
