"""Importance resampling, centroid clustering and SentencePiece ids against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from mediasift.llm import centroids
from mediasift.llm.centroids import Nearest, cluster_vectors
from mediasift.llm.resampling import bucket_gains, feature_buckets, ranked, resample
from mediasift.llm.sentence_pieces import PrefixTable, decode_pieces, encode_pieces
from tests.llm.conftest import words

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def plain_features(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(docs, target):
    s, t = (Counter(b for text in texts for b in plain_features(text)[1]) for texts in ([d[1] for d in docs], target))
    whole = (sum(s.values()), sum(t.values()))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (whole[0] + 10_000) / ((s[b] + 1.0) * (whole[1] + 10_000))))
    out = []
    for i, text in docs:
        w, f = plain_features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b) for b in f)
        out.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = Counter((r, n) for n, r in enumerate(may[: 5 * len(may) // 100], 1))
    return out, drawn


def test_resampling_agrees_with_brute_force(spark, odd_docs, odd_rows):
    rng = random.Random(8)
    more = [(1000 + i, words(rng, rng.randint(15, 60)), None, None) for i in range(300)] + [(2000 + i, "Hot text " * 12, None, None) for i in range(200)]
    target = [r[1] for r in more[:5]] + [None, "", "ÄÖ ünï hot"]
    docs = odd_docs.select("doc_id", "text", "_at", "key", "rep").unionByName(spark.createDataFrame(more, "doc_id long, text string, a string, b string").select("doc_id", "text"), allowMissingColumns=True)
    got = resample(docs, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    want, drawn = plain_resample([(r[0], r[1]) for r in [*odd_rows, *more]], target)
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    assert Counter((tuple(r)[:5], r["rank"]) for r in got if r["rank"] is not None) == drawn and len(drawn) > 20


def test_resampling_of_empty_tables(spark, no_docs):
    empty = spark.createDataFrame([], "text string")
    assert resample(no_docs, empty).count() == 0
    one = resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), empty).first()
    assert one["rank"] is None and one["n_features"] == 3 and one["weight"] == sum(bucket_gains(np.bincount(feature_buckets("a b")[1], minlength=10_000), np.zeros(10_000, np.int64))[feature_buckets("a b")[1]])


def test_ranks_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr("mediasift.llm.resampling.SORT_ROWS", 50)
    rows = [(i if i % 50 else None, i % 7) for i in range(1000)]
    got = ranked(spark.createDataFrame(rows, "doc_id long, score long").repartition(5), 1000)
    want = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    assert [(r["doc_id"], r["score"]) for r in sorted(got.collect(), key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 1001))


def plain_clusters(vectors, k, rounds, seed, dim, factor):
    kept = [(i, [math.floor(factor * x) for x in v]) for i, v in vectors if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    centres = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centres)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    own = Counter()
    for _, c, d in found:
        own[c] += d
    return Counter((i, c, d, own[c], sum(own.values()), tuple(centres[c])) for i, c, d in found)


@pytest.mark.parametrize(("k", "dim", "factor"), [(5, 4, 256), (12, 3, 2), (900, 4, 256)])
def test_clusters_agree_with_brute_force(spark, k, dim, factor):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=dim).tolist()) for i in range(300)] + [(300 + i, [0.5] * dim) for i in range(60)] + [(7, [0.25] * dim), (7, [0.25] * dim)]
    odd = [(900, None), (901, []), (902, [1.0, None, *[0.0] * (dim - 2)]), (903, [float("nan")] * dim), (904, [float("inf")] * dim), (905, [1.0] * (dim + 1))]
    df = spark.createDataFrame([(*v, 0) for v in vectors + odd], "vec_id long, embedding array<double>, cluster int").repartition(4)
    got = cluster_vectors(df, k, 3, 2, dim, factor).collect()
    assert Counter((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], tuple(r["centroid"])) for r in got) == plain_clusters(vectors, k, 3, 2, dim, factor)


def test_clusters_of_few_and_huge_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert cluster_vectors(spark.createDataFrame([], schema)).count() == 0
    assert [r["cluster"] for r in cluster_vectors(spark.createDataFrame([(1, [0.5] * 64)], schema)).collect()] == [0]
    assert cluster_vectors(spark.createDataFrame([(None, [0.5] * 64), (None, [0.5] * 64)], schema)).count() == 2
    with pytest.raises(Exception, match="would not fit a long"):
        cluster_vectors(spark.createDataFrame([(1, [1e30] * 64)], schema))


def test_screen_recomputes_what_float32_cannot_tell(monkeypatch):
    """Components of 2**26 whose distances differ by little: float32 products alone would choose wrongly."""
    rng = np.random.default_rng(9)
    centre = rng.integers(-(2**26), 2**26, 64)
    centres = centre + rng.integers(-3, 4, (50, 64))
    v = (centre + rng.integers(-3, 4, (400, 64))).astype(np.int32)
    exact = ((v[:, None, :].astype(np.int64) - centres[None]) ** 2).sum(axis=2)
    monkeypatch.setattr(centroids, "BLOCK", 3000)
    nearest = Nearest(centres)
    cluster, distance = nearest(v)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all() and nearest.recomputed == 400
    narrow = v.astype(np.float32) @ centres.T.astype(np.float32)
    assert ((centres**2).sum(axis=1) - 2 * narrow).argmin(axis=1).tolist() != cluster.tolist()
    small = Nearest(rng.integers(-256, 256, (40, 64)))
    small(rng.integers(-256, 256, (500, 64)).astype(np.int32))
    assert small.recomputed < 5  # the screen alone settles nearly all


ODD_TEXTS = ["", " ", "a", " a", "a  ", "  a   b", "\n", "a\nb", "\t", "▁a", "a\x00b", "ﬁ é 　x", "<s> </s> <0x0A> <unk>", "😀 a😀b", "a▁▁b", "​\r\n�", "a" * 500, "abcabc" * 300, "x" + " " * 100, " " * 100 + "\n", "你好世界，今天天气不错。" * 20, "foo².bar", "don't (e.g.) \"this\"; that: 12.5%"]


def test_prefix_table_agrees_with_the_library(monkeypatch):
    sp, table, rng = SentencePieceProcessor(model_file=MODEL), PrefixTable(MODEL), random.Random(2)
    parts = ["a", "b", "e", "the", "th", " ", "  ", "\n", ".", ",", "ing", "é", "²", "1", "23", "▁", "😀", "你", "(", "'", "-", "_", "<", "/", "\x00", "ß", "ation", " and"]
    texts = ODD_TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 90))) for _ in range(4000)]
    monkeypatch.setattr("mediasift.llm.sentence_pieces.KEEP", 2000)  # segments are let go and met again
    for k in range(0, len(texts), 500):
        ids, counts = table.encode(texts[k : k + 500])
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == sp.encode(texts[k : k + 500])
    monkeypatch.setattr("mediasift.llm.sentence_pieces.TABLE_CHARS", 3)  # nearly all words one place at a time
    table.clear()
    ids, counts = table.encode(texts[:800])
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == sp.encode(texts[:800])


def test_compatible_pairs_are_those_that_stay():
    sp, table, rng = SentencePieceProcessor(model_file=MODEL), PrefixTable(MODEL), random.Random(6)
    names = [sp.id_to_piece(int(i)) for i in table.ids]
    pairs = [(rng.randrange(table.n), rng.randrange(table.n)) for _ in range(3000)] + [(rng.randrange(4000), rng.randrange(4000)) for _ in range(3000)]
    pairs = [(a, b) for a, b in pairs if "▁" not in names[a] + names[b]]
    got = table.compatible(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    want = [sp.encode("\n" + names[a] + names[b])[2:] == [int(table.ids[a]), int(table.ids[b])] for a, b in pairs]
    assert got.tolist() == want and 0.05 < np.mean(want) < 0.999


def test_pieces_of_odd_documents(spark, odd_docs, odd_rows, no_docs):
    sp = SentencePieceProcessor(model_file=MODEL)
    rows = [*odd_rows, *((500 + i, t, None, None) for i, t in enumerate(ODD_TEXTS))]
    docs = odd_docs.unionByName(spark.createDataFrame([(r[0], r[1]) for r in rows[len(odd_rows) :]], "doc_id long, text string"), allowMissingColumns=True)
    got = decode_pieces(encode_pieces(docs, MODEL), MODEL)
    assert got.columns == [*docs.columns, "ids", "decoded"]
    want = Counter((r[0], r[1], tuple(sp.encode(r[1] or "", add_eos=True)), sp.decode(sp.encode(r[1] or "", add_eos=True))) for r in rows)
    assert Counter((r["doc_id"], r["text"], tuple(r["ids"]), r["decoded"]) for r in got.collect()) == want
    assert encode_pieces(no_docs, MODEL).count() == 0
    named = encode_pieces(docs.select("doc_id", "text").withColumn("ids", docs["text"]), MODEL, end=False)  # replaced
    assert {tuple(r["ids"]) for r in named.collect()} == {w[2][:-1] for w in want}
    assert decode_pieces(spark.createDataFrame([(None,), ([],)], "ids array<int>"), MODEL).collect()[0]["decoded"] == ""
