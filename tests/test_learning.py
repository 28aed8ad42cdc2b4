"""Learning within a run against the plain loop."""

import random

import pytest

from mediasift.operators import learning
from mediasift.operators.learning import added_entries, learn_in_order
from mediasift.operators.routing import Learning


def plain_loop(inputs, entries, how, radius, both):
    lists = {k: [(b, -1) for kind, b in entries if kind == k and b is not None] for k in ("block", "allow")}
    out, added = {}, []
    for turn, first, last, own in sorted(inputs):
        seen = [x for x in ((first, last) if both else (first,)) if x is not None]
        found = {k: min(((e ^ x).bit_count(), since) for e, since in held for x in seen) if held and seen else (99, 0) for k, held in lists.items()}
        kind = next((k for k in ("block", "allow") if found[k][0] <= radius[k]), None)
        label = {"block": "BLOCK", "allow": "OK"}.get(kind, own)
        out[turn] = (label, kind, found[kind][0] if kind else None, found[kind][1] >= 0 if kind else None)
        to = {"BLOCK": "block", "OK": "allow"}.get(label)
        if to and how.learns(label):
            for x in dict.fromkeys((first, last) if how.first_and_last else (first,)):
                if x is not None and x not in [e for e, _ in lists[to]]:
                    lists[to].append((x, turn))
                    added.append((to, x, turn, how.block_label if to == "block" else how.allow_label))
    return out, sorted(added)


@pytest.mark.parametrize(("how", "both", "radius"), [
    (Learning(enabled=True, first_and_last=True), True, {"block": 1, "allow": 1}),
    (Learning(enabled=True), False, {"block": 2, "allow": 0}),
    (Learning(enabled=True, block=False), True, {"block": 0, "allow": 2}),
    (Learning(enabled=True, first_and_last=True, allow=False), False, {"block": 1, "allow": 1}),
    (Learning(enabled=False, append=True, block=True), True, {"block": 1, "allow": 1}),
])
def test_agrees_with_the_plain_loop(spark, monkeypatch, how, both, radius):
    monkeypatch.setattr(learning, "ROWS_A_PART", 10)
    rng = random.Random(len(repr(how)) + both)
    inputs = [(t * 3, rng.randrange(256), rng.choice([None, rng.randrange(256)]), rng.choice(["OK", "BLOCK", "REVIEW", "REVIEW"])) for t in range(150)]
    inputs += [(1000 + t, 77, 77, rng.choice(["OK", "BLOCK", "REVIEW"])) for t in range(60)] + [(2000, None, None, "OK"), (2001, None, 5, "REVIEW")]
    entries = [("block", 1), ("block", 1), ("allow", 254), ("allow", None), ("other", 77)]
    df = spark.createDataFrame(inputs, "turn long, first long, last long, own string").repartition(4)
    listed = spark.createDataFrame(entries, "list_kind string, bits long")
    judged = learn_in_order(df, listed, how, radius["block"], radius["allow"], both)
    want, added = plain_loop(inputs, entries, how, radius, both)
    assert {r["turn"]: (r["label"], r["settled_by"], r["distance"], r["learned"]) for r in judged.collect()} == want
    got = added_entries(df, judged, listed, how).collect()
    assert sorted((r["list_kind"], r["bits"], r["turn"], r["label"]) for r in got) == added


def test_a_chain_takes_as_many_steps_as_it_is_long(spark, monkeypatch):
    steps = []
    plain = learning._judge
    monkeypatch.setattr(learning, "_judge", lambda *a: steps.append(1) or plain(*a))
    chain = [(i, (1 << i) - 1, None, "REVIEW") for i in range(1, 9)]  # each one bit from the next
    df = spark.createDataFrame(chain, "turn long, first long, last long, own string")
    how = Learning(enabled=True)
    got = learn_in_order(df, spark.createDataFrame([("block", 0)], "list_kind string, bits long"), how, 1).collect()
    assert all(r["label"] == "BLOCK" for r in got) and len(steps) == 9
    steps.clear()
    back = df.selectExpr("100 - turn AS turn", "first", "last", "own")  # the other way round nothing is learned in time
    got = learn_in_order(back, spark.createDataFrame([("block", 0)], "list_kind string, bits long"), how, 1).collect()
    assert [r["label"] for r in sorted(got, key=lambda r: r["turn"])] == ["REVIEW"] * 7 + ["BLOCK"] and len(steps) == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], "turn long, first long, last long, own string")
    lists = spark.createDataFrame([], "list_kind string, bits long")
    assert learn_in_order(none, lists, Learning(enabled=True)).count() == 0
    one = spark.createDataFrame([(1, 5, 5, "OK"), (2, 5, 5, "REVIEW")], none.schema)
    assert [r["label"] for r in learn_in_order(one, lists, Learning(enabled=True)).orderBy("turn").collect()] == ["OK", "OK"]
    assert [r["label"] for r in learn_in_order(one, lists, Learning()).orderBy("turn").collect()] == ["OK", "REVIEW"]
