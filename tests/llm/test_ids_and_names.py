"""Rows without ids, and columns whose names the stages use."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from mediasift.llm import language, packing
from mediasift.llm.common import unused_names
from mediasift.llm.queries import tokenizer_path
from tests.llm.conftest import words


def test_languages_are_learned_whatever_the_ids(spark):
    rng = random.Random(4)
    texts = [(" ".join("".join(rng.choice(["ka", "ko", "ki"]) for _ in range(3)) for _ in range(12)), "aa") for _ in range(2500)]
    texts += [(" ".join("".join(rng.choice(["lu", "mel", "em"]) for _ in range(3)) for _ in range(12)), "bb") for _ in range(20)]
    texts += [(texts[0][0], "aa")] * 3000
    rows = spark.createDataFrame(texts, "text string, lang string").repartition(4)
    models = [language.fit(rows.withColumn("doc_id", i.cast("long"))) for i in (F.monotonically_increasing_id(), F.lit(None), F.lit(7))]
    first = models[0]
    assert first.languages == ["aa", "bb"]
    for m in models[1:]:
        assert m.languages == first.languages and m.usual == first.usual
        assert all((a == b).all() for x, y in zip(m.models, first.models, strict=True) for a, b in zip(x.alphas, y.alphas, strict=True))
    assert language.identify(rows.withColumn("doc_id", F.lit(None).cast("long")), models[1]).filter("rejected").count() == 0


def test_names_of_columns_do_not_matter(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, words(rng, 30), "aa", f"s{i % 2}", 0) for i in range(40)]
    names = ["_position", "position", "gone_id", "count", "__slot", "__block", "_offset", "__offset", "_lang_pred", "__score", "_rejected", "_metadata_x", "sequence_id"]
    docs = spark.createDataFrame([(*r, *(f"v{r[0]}" for _ in names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.filter("gone_id <> concat('v', doc_id) or `__slot` <> concat('v', doc_id)").count() == 0 and docs.count() == 40
    packed = corpus_pipeline.packed(spark, docs, "").collect()
    plain = packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path()).collect()
    hijacked = packing.pack_documents(docs.withColumn("_position", F.col("doc_id") * 7), tokenizer_path()).collect()
    assert len(packed) == len(plain) and sorted(map(str, hijacked)) == sorted(map(str, plain))
    assert unused_names(docs, ("slot", "offset")) == ("___slot", "___offset")


def test_an_empty_table_through_the_pipeline(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_parts_grow_where_there_would_be_too_many():
    from mediasift.llm.common import MANY_PARTS, bounded_parts

    assert [bounded_parts(n, 10, 100) for n in (0, 1, 10, 11, 10 * MANY_PARTS)] == [1, 1, 1, 2, MANY_PARTS]
    assert bounded_parts(11 * MANY_PARTS, 10, 100) == MANY_PARTS and bounded_parts(1000 * MANY_PARTS, 10, 100) == 10 * MANY_PARTS


def test_sources_too_small_for_the_frame_are_told():
    import warnings

    import pytest

    from mediasift.llm.mixing import tempered

    with pytest.warns(UserWarning, match="share a frame"):
        assert set(tempered({f"s{i}": 1 + i for i in range(5000)}).values()) == {1}
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert sum(tempered({"a": 1000, "b": 10, None: 1}).values()) >= 998 and tempered({}) == {}
