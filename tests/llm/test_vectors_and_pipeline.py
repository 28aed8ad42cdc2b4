"""Embeddings against brute force; components; the pipeline's stages on a small corpus."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mediasift.llm import mixing, shingle_dedup, vector_dedup
from mediasift.llm.common import connected_components, prefix_sums
from tests.llm.conftest import components

ODD = [None, [0.0, 0.0, 0.0], [1.0, None, 0.0], [1.0, float("nan"), 0.0], [1.0, float("inf"), 0.0], [], [1.0, 0.0]]


def brute(rows, cosine):
    ids = sorted({i for i, _ in rows})
    good = [(i, np.array(v) / np.abs(v).max()) for i, v in rows if v is not None and len(v) == 3 and None not in v and np.isfinite(v).all() and np.any(v)]
    good = [(i, v / np.linalg.norm(v)) for i, v in good]
    links = {i: 0 for i in ids}
    pairs = []
    for a, (i, x) in enumerate(good):
        for b, (j, y) in enumerate(good):
            if a != b and x @ y >= cosine:
                links[i] += 1
                pairs.append((ids.index(i), ids.index(j)))
    return ids, links, [ids[c] for c in components(len(ids), pairs)]


@pytest.mark.parametrize("rows_a_cell", [4096, 16])
def test_near_vectors(spark, monkeypatch, rows_a_cell):
    monkeypatch.setattr(vector_dedup, "CELL_ROWS", rows_a_cell)
    monkeypatch.setattr(vector_dedup, "VECTORS_A_PIVOT", 40)
    monkeypatch.setattr(vector_dedup, "REPLICA_ROWS", 50)
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=3).round(3).tolist() for _ in range(150)]
    vectors += [vectors[0]] * 3 + [[2 * x for x in vectors[1]], [-0.0, 1.0, 0.0], [0.0, 1.0, 0.0], [1e300, 1e300, 0.0], [1e-300, 1e-300, 0.0], *ODD]
    rows = list(enumerate(vectors))
    df = spark.createDataFrame([(i, v, i, 1) for i, v in rows], "vec_id bigint, embedding array<double>, n int, rep int").repartition(3)
    ids, links, component = brute(rows, 0.95)
    got = {r["vec_id"]: r for r in vector_dedup.near_vectors(df).collect()}
    assert sorted(got) == ids and {i: got[i]["n_links"] for i in ids} == links
    assert [got[i]["component_id"] for i in ids] == component and all(got[i]["kept"] == (got[i]["component_id"] == i) for i in ids)


def test_vectors_of_several_lengths(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([(1, 0), (2, 0), (1, 0, 0), (1, 0, 0), (0, 1), (1, 0, 0), (1,), (3,), (-1,), (1, 0, 0, 0)])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_vectors(df).collect()}
    assert got == {0: (1, 0, True), 1: (1, 0, False), 2: (2, 2, True), 3: (2, 2, False), 4: (0, 4, True), 5: (2, 2, False), 6: (1, 6, True), 7: (1, 6, False), 8: (0, 8, True), 9: (0, 9, True)}


def test_vectors_without_any_usable_row(spark):
    df = spark.createDataFrame(list(enumerate(ODD[:6])), "vec_id bigint, embedding array<double>")
    assert {(r["n_links"], r["kept"]) for r in vector_dedup.near_vectors(df).collect()} == {(0, True)}
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0
    some = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in vector_dedup.near_vectors(some).collect()) == [(0, 0), (3, 1), (3, 1)]


def test_cosine_at_the_threshold(spark):
    angle = np.arccos(0.95)
    rows = [(0, [1.0, 0.0]), (1, [np.cos(angle - 1e-9), np.sin(angle - 1e-9)]), (2, [np.cos(angle + 1e-9), -np.sin(angle + 1e-9)])]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id bigint, embedding array<double>")
    assert {r["vec_id"]: r["n_links"] for r in vector_dedup.near_vectors(df).collect()} == {0: 1, 1: 1, 2: 0}


def test_components(spark):
    rng = np.random.default_rng(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    edges = chain + [(int(a), int(b)) for a, b in rng.integers(0, 100, (60, 2))] + [(500, x) for x in range(501, 560)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = components(600, edges)
    assert got == {i: want[i] for e in edges if e[0] != e[1] for i in e}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_prefix_sums_of_a_hot_key(spark):
    df = spark.range(500).select(F.when(F.col("id") < 300, "hot").when(F.col("id") < 480, "warm").alias("k"), "id")
    got = prefix_sums(df, ["k"], [F.col("id")], F.col("id"), "before", 500, per_bucket=20, total="whole").toPandas()
    for _, g in got.groupby("k", dropna=False):
        g = g.sort_values(["before", "id"])
        assert (g.id.cumsum() - g.id == g.before).all() and (g.whole == g.id.sum()).all()


def test_stages_on_planted_cases(spark, tmp_path):
    rng = np.random.default_rng(7)
    stems = {"aa": ["ka", "ko", "ki", "tak"], "bb": ["lu", "mel", "ul", "em"]}
    rows = [(i, " ".join("".join(rng.choice(stems[lang], rng.integers(1, 4))) for _ in range(rng.integers(20, 90))), lang, f"s{i % 4}") for i, lang in enumerate(["aa", "bb"] * 30)]
    copy, near = rows[4][1], rows[6][1].split()
    near[-1:] = ["changed"]
    rows += [(200, copy.replace(" ", "\n"), "aa", "s1"), (201, rows[8][1], "aa", "s2"), (202, "12345 !!!", "aa", "s0"), (203, None, "aa", "s0"), (204, "вщъ жчшя qwxj pffgh wqpx ъэщ xjqw", None, "s0")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert name == "best_fit_packing" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    everything = {r[0] for r in rows}
    assert everything - seen["language_id"] == {202, 203, 204}
    assert seen["language_id"] - seen["exact_dedup"] == {200, 201}
    assert seen["exact_dedup"] == seen["simhash_near_dedup"] == seen["mixing"] == seen["best_fit_packing"]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == seen["best_fit_packing"]


@pytest.mark.parametrize("group_rows,pair_rows", [(16, 64), (3, 64), (3, 4)])
def test_near_copies_by_jaccard(spark, tmp_path, monkeypatch, group_rows, pair_rows):
    monkeypatch.setattr(shingle_dedup, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(shingle_dedup, "PAIR_ROWS", pair_rows)
    monkeypatch.setattr(shingle_dedup, "CHUNK_ROWS", 7)
    monkeypatch.setattr(shingle_dedup, "candidate_pairs", lambda rows: rows.selectExpr("doc_id AS u", "doc_id AS v").limit(0))  # the filter alone misses nothing
    rng = np.random.default_rng(2)
    rows = [(i, " ".join("".join(rng.choice(list("abcdef"), 4)) for _ in range(rng.integers(20, 160)))) for i in range(40)]
    for i in range(40, 120):  # copies with words changed in any place
        words = rows[i % 9][1].split()
        for _ in range(rng.integers(1, 3)):
            words[rng.integers(len(words))] = "new" + str(rng.integers(9))
        rows.append((i, " ".join(words)))
    near = rows[6][1].split()
    near[-1:] = ["changed"]
    rows += [(200, " ".join(near)), (201, None), (202, ""), (None, rows[3][1])]
    passage = " ".join("".join(rng.choice(list("abcdef"), 4)) for _ in range(90))
    for i in range(300, 330):  # a passage that is most of some documents, with tails of many lengths
        rows.append((i, passage + " " + " ".join(f"tail{i % 11}x{k}" for k in range(int(rng.integers(5, 60))))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    some = [(i, {tuple((t or "").lower().split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))}) for i, t in rows if i is not None]
    pairs = [(a, b) for a, (_, x) in enumerate(some) for b, (_, y) in enumerate(some[:a]) if 5 * len(x & y) >= 4 * len(x | y)]
    want = {some[c][0] for c in components(len(some), pairs)}
    df.write.parquet(f"{tmp_path}/docs")
    got = corpus_pipeline.without_near_copies(spark, spark.read.parquet(f"{tmp_path}/docs"), "").collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(want) and len(got) == len(want) + 1
    assert 200 not in want and len(want) < 110 and 1 < len(want & set(range(300, 330))) < 25


def test_mixture_weights_change_the_packed_rows(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join("".join(rng.choice(["ka", "ko", "ki", "tak"], 3)) for _ in range(int(rng.choice([100, 240, 400])))), "aa", f"s{i % 2}") for i in range(120)]
    spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    source, got = {r[0]: r[3] for r in rows}, []
    for heavy in ("s0", "s1"):
        weights = {"s0": 1, "s1": 1} | {heavy: 9}
        monkeypatch.setattr(corpus_pipeline, "mix", lambda docs, weights=weights, **named: mixing.mix(docs, weights, 512, **named))
        packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
        got.append({(r["doc_id"], r["piece"], r["sequence_id"], r["offset"]) for r in packed})
        n = len({r["sequence_id"] for r in packed})
        assert {r["sequence_id"] for r in packed} == set(range(n))
        first = [source[r["doc_id"]] for r in packed if r["offset"] == 0 and r["sequence_id"] < n // 3]
        assert first.count(heavy) > 0.75 * len(first)
    assert got[0] != got[1] and {x[:2] for x in got[0]} == {x[:2] for x in got[1]}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_pipeline_on_the_smallest_tables(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
