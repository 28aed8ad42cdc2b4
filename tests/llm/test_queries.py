"""The opN_ queries over small tables of their own, against brute force and their SQL."""

import random
import zlib

import duckdb
import numpy as np
import pytest

from mediasift.llm import queries as q
from mediasift.llm.tokens import PieceEncoder
from tests.llm.conftest import words


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents and embeddings with nulls, copies, links and vectors of two lengths."""
    rng, np_rng = random.Random(3), np.random.default_rng(3)
    rows = [(i, words(rng, rng.randint(1, 80)), rng.choice(["xx", "yy"]), f"s{i % 3}") for i in range(120)]
    rows += [(200, None, "xx", "s0"), (201, "", None, None), (202, rows[3][1] + " ", "xx", "s0"), (203, "GNU General Public License. apache license, CC BY cc-by", "yy", "s1"), (None, "no id", None, None)]
    vectors = [(i, (v := np_rng.normal(size=8)).tolist()) for i in range(60)]
    vectors += [(100 + i, (np.array(vectors[i % 7][1]) + np_rng.normal(size=8) * 0.15).tolist()) for i in range(40)]
    vectors += [(300 + i, np_rng.normal(size=64).tolist()) for i in range(70)]
    vectors += [(200, None), (201, [0.0] * 8), (202, [1.0, None]), (203, [1.0, 0.0]), (204, [1.0, 0.01]), (205, []), (206, [float("nan")] * 8)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(*v, 1) for v in vectors], "vec_id bigint, embedding array<float>, label int").repartition(2).write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(0, rows[4][1]), (1, None), (2, "gnu general Ünï")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_agrees_with_its_sql(spark, tables, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables[0]}/{t}.parquet/*.parquet'")
    theirs = duck.execute(q.oracle_sql()[name])
    columns = [c[0] for c in theirs.description]
    ours = q.queries()[name](spark, tables[0]).select(*columns)
    plain = lambda rows: sorted(map(str, rows))
    assert plain(map(tuple, ours.collect())) == plain(theirs.fetchall())
    if name.startswith("op2"):
        assert ours.filter("n_links > 0").count() > 20 and ours.filter("vec_id in (203, 204) and n_links = 1").count() == 2


def test_digest_columns(spark, tables):
    path, rows = tables
    text = {r[0]: r[1] or "" for r in rows}
    got = {name: f(spark, path) for name, f in q.queries().items()}
    remainder = lambda i, n: False if i is None else zlib.crc32(str(i).encode()) % n == 1
    for name, n in (("op5_language_id", 3), ("op9_lm_scoring", 5)):
        assert {r["doc_id"]: r["held_out"] for r in got[name].collect()} == {i: remainder(i, n) for i in text}
    shards = got["op8_sharding"].collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in shards} == {i: (len(t.encode()) + 16, zlib.crc32(t.encode()), "rows", None) for i, t in text.items()}
    assert {r["shard"] for r in shards} == set(range(40)) and max(r["slot"] for r in shards) == 3
    prints = {r["doc_id"]: r["fingerprint"] for r in got["op6_simhash_near_dedup"].collect()}
    assert prints[200] == prints[201] == "0" * 16 and all(len(f) == 16 and f == f.lower() for f in prints.values())
    lm = got["op9_lm_scoring"].collect()
    assert {r["train_tokens"] for r in lm} == {sum(len(t.lower().split()) + 1 for i, t in text.items() if not remainder(i, 5))}
    licence = {r["doc_id"]: r for r in got["op10_licence_scan"].collect()}[203]
    assert (licence["n_words"], licence["n_base"], licence["first_word"], licence["last_word"], licence["base_labels"]) == (10, 4, 0, 8, "apache,cc-by,gpl")
    for name, n in (("op1_best_fit_packing", 2), ("op3_token_files", 0)):
        ids = lambda t: [*PieceEncoder.of(q.tokenizer_path()).direct([t])[0], n]  # noqa: B023, E731
        crcs = {(r["doc_id"], r["ids_crc32"]) for r in got[name].collect()}
        assert crcs == {(i, zlib.crc32(np.array(ids(t), "<u4").tobytes())) for i, t in text.items()}
