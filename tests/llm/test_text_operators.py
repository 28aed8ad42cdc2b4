"""Operators on texts against brute force, with odd rows and empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mediasift.llm import language, lm_score, mixing
from mediasift.llm.exact_dedup import drop_duplicates, duplicate_groups
from mediasift.llm.licence_texts import PHRASES, TEMPLATES
from mediasift.llm.licences import Scanner, scan_licences, words
from mediasift.llm.packing import pack_documents, plan
from mediasift.llm.queries import queries, tokenizer_path
from mediasift.llm.sharding import external_shuffle, write_shards
from mediasift.llm.simhash import fingerprint_batch, keep_one, leaves, link_forest, near_duplicates, parts_of, plan_bands
from mediasift.llm.token_files import LEAST_COUNT, Block, compress, token_documents
from mediasift.llm.tokens import PieceEncoder
from tests.llm.conftest import components

WHITE = r"[\x20\x09-\x0D]"


def direct_ids(text):
    e = PieceEncoder.of(tokenizer_path())
    return e.direct([text or ""])[0]


def test_pieces_encode_like_whole_texts(odd_rows):
    rng = np.random.default_rng(2)
    bits = list("aB1 ,.\n'\té!") + ["'s", "<|endoftext|>", " the", ". ", "  ", "\x00"]
    texts = [r[1] for r in odd_rows] + ["".join(rng.choice(bits, rng.integers(0, 14))) for _ in range(5000)]
    ids, at = PieceEncoder.of(tokenizer_path()).encode(pa.array(texts))
    assert all(ids[at[i] : at[i + 1]].tolist() == direct_ids(t) for i, t in enumerate(texts))


def test_piece_cache_may_be_emptied():
    small = PieceEncoder(tokenizer_path(), limit=3)
    for text in ("one two three four five", "six seven one two", "one"):
        ids, _ = small.encode(pa.array([text]))
        assert ids.tolist() == direct_ids(text)


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(1)
    for _ in range(60):
        capacity = int(rng.integers(5, 40))
        lengths = sorted(rng.integers(1, capacity + 1, rng.integers(1, 200)).tolist(), reverse=True)
        gaps: list[int] = []
        for n in lengths:
            fit = [g for g in gaps if g >= n]
            if fit:
                gaps[gaps.index(min(fit))] -= n
            else:
                gaps.append(capacity - n)
        used = Counter()
        places = set()
        for length, _, n, first, offset in plan(Counter(lengths), capacity):
            for k in range(n):
                places |= {(first + k, offset + x) for x in range(length)}
                used[first + k] += length
        assert sum(used.values()) == len(places) == sum(lengths) and max(used.values()) <= capacity
        assert len(used) == len(gaps)


def test_packing(spark, odd_docs, odd_rows, no_docs):
    got = pack_documents(odd_docs, tokenizer_path(), 64, 2).toPandas()
    assert got["length"].sum() == sum(len(direct_ids(r[1])) + 1 for r in odd_rows) and got["length"].max() <= 64
    by_id = {r[0]: np.array([*direct_ids(r[1]), 2], "<u4") for r in odd_rows if r[0] is not None}
    for r in got[got.doc_id.notna()].itertuples():
        assert zlib.crc32(by_id[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32
        assert r.length == 64 or r.piece == 0
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id")["length"].cumsum() - placed["length"] == placed["offset"]).all()
    assert pack_documents(no_docs, tokenizer_path()).count() == 0


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    for vocabulary in (300, 200_000):
        docs = [rng.integers(0, 5, rng.integers(1, 60)).tolist() * int(rng.integers(1, 9)) for _ in range(80)] + [[vocabulary - 1], []]
        at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        block = Block(payload := compress(np.concatenate([np.array(d, np.uint32) for d in docs]), at, vocabulary))
        assert [block.document(i).tolist() for i in range(len(docs))] == docs
        ids, back = block.all()
        assert (back == at).all() and ids.tolist() == sum(docs, [])
        assert len(payload) < 4 * at[-1]
        parts = [block.symbols[block.starts[i] : block.starts[i + 1]].tolist() for i in range(len(docs))]
        seen = Counter(pair for x in parts for pair in zip(x[:-1], x[1:], strict=True))
        assert max(seen.values()) < LEAST_COUNT and block.lengths.max() > 8  # rules nest until no pair is frequent
    with pytest.raises(ValueError):
        Block(b"nope" + payload)


def test_token_files(odd_docs, odd_rows, no_docs):
    got = token_documents(odd_docs, tokenizer_path()).toPandas().sort_values("start")
    want = Counter((r[0], zlib.crc32(np.array([*direct_ids(r[1]), 0], "<u4"))) for r in odd_rows)
    assert Counter((None if np.isnan(i) else int(i), int(c)) for i, c in zip(got.doc_id, got.ids_crc32, strict=True)) == want
    assert (got.n_tokens.cumsum() - got.n_tokens == got.start).all()
    ids = got.doc_id.dropna().tolist()
    assert ids == sorted(ids) and got.doc_id.isna().tolist()[:2] == [True, True]
    assert token_documents(no_docs, tokenizer_path()).count() == 0


def test_exact_dedup(odd_docs, odd_rows, no_docs):
    got = duplicate_groups(odd_docs, digest_all=True).collect()
    normal = [re.sub(WHITE, "", r[1] or "") for r in odd_rows]
    sizes = Counter(normal)
    head = {}
    for r, n in zip(odd_rows, normal, strict=True):
        key = (-len(r[1] or ""), r[0] is None, r[0] or 0)
        head[n] = min(head.get(n, (key, r[0])), (key, r[0]), key=lambda x: x[0])
    digest = {hashlib.sha256(n.encode()).hexdigest(): n for n in normal}
    assert len(got) == len(odd_rows)
    for r in got:
        n = digest[r["text_sha256"]]
        assert r["group_size"] == sizes[n] and r["keep_id"] == head[n][1]
    assert Counter(digest[r["text_sha256"]] for r in got if r["kept"]) == Counter(set(normal))
    kept = drop_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and Counter(re.sub(WHITE, "", r["text"] or "") for r in kept.collect()) == Counter(set(normal))
    assert duplicate_groups(no_docs).count() == drop_duplicates(no_docs).count() == 0


def test_language(odd_docs, no_docs):
    model = language.fit(odd_docs)
    got = language.identify(odd_docs, model)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["rejected"] and rows[i]["score"] == 0 for i in (100, 101, 102, 103))
    assert got.count() == odd_docs.count() and set(odd_docs.columns) <= set(got.columns)
    assert language.identify(no_docs, language.fit(no_docs)).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd_docs, language.fit(no_docs)).collect()} == {"und"}


def test_language_held_out(spark):
    rng = np.random.default_rng(4)
    stems = {"aa": ["ka", "ko", "ki", "tak"], "bb": ["lu", "mel", "ul", "em"], "cc": ["zor", "raz", "oz", "ra"]}
    rows = [(i, " ".join("".join(rng.choice(stems[lang], rng.integers(1, 4))) for _ in range(rng.integers(3, 40))), lang) for i, lang in enumerate(list(stems) * 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language.identify(docs, language.fit(docs, F.col("doc_id") % 4 != 1)).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) == 1.0 and not any(r["rejected"] for r in got)
    other = spark.createDataFrame([(1, "qwxj вщъ pffgh жчшя wqpx ъэщ xjqw"), (2, None)], "doc_id bigint, text string")
    assert [r["rejected"] for r in language.identify(other, language.fit(docs)).collect()] == [True, True]


def test_language_of_long_documents_only(spark):
    rng = np.random.default_rng(6)
    stems = {"aa": ["ka", "ko", "ki", "tak"], "bb": ["lu", "mel", "ul", "em"]}
    rows = [(i, " ".join("".join(rng.choice(stems[lang], 3)) for _ in range(n)), lang) for i, (lang, n) in enumerate([("aa", 60), ("bb", 2000)] * 12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for some in (docs, docs.filter("lang = 'bb'")):
        got = language.identify(some, language.fit(some)).collect()
        assert got and all(r["lang_pred"] == r["lang"] and not r["rejected"] for r in got)


def brute_kneser_ney(texts, order):
    """p(character | history) of an interpolated Kneser-Ney model, from plain counts."""
    seqs = ["\1" + w + "\2" for t in texts for w in t.split()]
    events = [s[max(0, p - order + 1) : p + 1] for s in seqs for p in range(1, len(s))]
    tables = []
    for k in range(1, order + 1):
        count = Counter(e for e in events if len(e) == k)
        if k < order:  # else the number of different characters before
            count.update(g[1:] for g in {e[len(e) - k - 1 :] for e in events if len(e) > k})
        n = Counter(count.values())
        tables.append((count, n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5))

    def p(gram, alphabet):
        out = 1 / alphabet
        for k, (count, d) in enumerate(tables[: len(gram)], 1):
            g = gram[len(gram) - k :]
            after = {x: c for x, c in count.items() if x[:-1] == g[:-1]}
            if after:
                out = max(count[g] - d, 0) / sum(after.values()) + d * len(after) / sum(after.values()) * out
        return out

    return p


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_character_model_is_interpolated_kneser_ney(order):
    texts = ["abc abd acd bcd dab abc abc", "cab bad abad a b ad"]
    model, p = language.train(texts, order), brute_kneser_ney(texts, order)
    words = ["abc", "a", "dcba", "xab", "badabad", "bb"]
    for alphabet in (6, 1024):
        model.alphabet = alphabet
        seqs = ["\1" + w + "\2" for w in words]
        want = [sum(np.log2(p(s[max(0, i - order + 1) : i + 1], alphabet)) for i in range(1, len(s))) for s in seqs]
        got, sizes = model.log2(words)
        assert got.tolist() == pytest.approx(want) and sizes.tolist() == [len(w) + 1 for w in words]
    letters = sorted(set("".join(texts)) - {" "}) + ["\2"]
    assert sum(p(("\1ab" + x)[-order:], len(letters)) for x in letters) == pytest.approx(1)


def test_calibrated_rejection_of_left_out_languages(spark):
    rng = np.random.default_rng(4)
    stems = {"aa": ["ka", "ko", "ki", "tak"], "bb": ["lu", "mel", "ul", "em"], "cc": ["zor", "raz", "oz", "ra"]}
    rows = [(i, " ".join("".join(rng.choice(stems[lang], rng.integers(1, 4))) for _ in range(rng.integers(8, 40))), lang) for i, lang in enumerate(list(stems) * 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for left in stems:
        got = language.identify(docs, language.fit(docs, F.col("lang") != left)).collect()
        assert np.mean([r["rejected"] for r in got if r["lang"] == left]) > 0.9
        assert not any(r["rejected"] for r in got if r["lang"] != left)


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(WHITE, low) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, odd_docs, odd_rows, no_docs):
    texts = [r[1] for r in odd_rows] + ["A b", "a B c", "one"]
    fps = [brute_fingerprint(t) for t in texts]
    assert fingerprint_batch(texts).tolist() == fps
    rows = [(r[0], f) for r, f in zip(odd_rows, fps, strict=False) if r[0] is not None]
    ids = sorted({i for i, _ in rows})
    pairs = [(ids.index(a), ids.index(b)) for a, x in rows for b, y in rows if (x ^ y).bit_count() <= 3]
    want = dict(zip(ids, (ids[c] for c in components(len(ids), pairs)), strict=True))
    got = [r for r in near_duplicates(odd_docs).collect() if r["doc_id"] is not None]
    assert len(got) == len(rows) and {r["doc_id"]: r["component_id"] for r in got} == want
    kept = keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == Counter(set(want.values()))
    assert near_duplicates(no_docs).count() == keep_one(no_docs).count() == 0


@pytest.mark.parametrize("distance,bands,levels", [(3, 4, 10), (3, 5, 10), (3, 7, 10), (3, 2, 3), (5, 2, 2), (2, 1, 2)])
def test_link_forest_finds_every_component(spark, monkeypatch, distance, bands, levels):
    monkeypatch.setattr("mediasift.llm.simhash.LEAF_ROWS", 8)  # many chunks
    rng = np.random.default_rng(6)
    centres = rng.integers(0, 1 << 63, 30)
    fps = np.unique([int(c) ^ sum(1 << int(b) for b in rng.integers(0, 63, rng.integers(0, 5))) for c in centres for _ in range(6)])
    points = spark.createDataFrame([(int(f), i) for i, f in enumerate(fps)], "fp bigint, rep bigint")
    edges = [(r["u"], r["v"]) for r in link_forest(points, distance, bands, levels).collect()]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= distance]
    assert all((int(fps[a]) ^ int(fps[b])).bit_count() <= distance for a, b in edges)
    assert components(len(fps), edges) == components(len(fps), pairs)


def test_parts_and_leaves(spark):
    masks, radius = parts_of(3, 5)
    assert radius == 0 and len(masks) == 10 and all(25 <= m.bit_count() <= 26 for m in masks)
    assert parts_of(3, 2)[1] == 1 and parts_of(3, 1) == ([(1 << 64) - 1], 3)
    assert [plan_bands(n, 3) for n in (100, 10**6, 10**9, 10**11)] == [4, 5, 6, 8]
    store, probe = leaves(F.lit(-1).cast("bigint"), masks, 0, 10)
    r = spark.range(1).select(store.alias("s"), probe.alias("p")).first()
    assert list(r["s"]) == list(r["p"]) and len(set(r["s"])) == 10


def test_pfair_frames_and_phases():
    rng = np.random.default_rng(8)
    for _ in range(60):
        weights = {f"s{i}": int(w) for i, w in enumerate(rng.integers(1, 30, rng.integers(1, 8)))}
        length, slots = sum(weights.values()), mixing.frame_slots(weights)
        assert sorted(x for v in slots.values() for x in v) == list(range(length))
        for s, v in slots.items():
            assert all(abs(sum(x < t for x in v) - weights[s] * t / length) < 1 for t in range(length + 1))
        blocks = {s: int(n) for s, n in zip(weights, rng.integers(0, 70, len(weights)), strict=True)}
        taken = set()
        for s, phases in mixing.phases(blocks, weights).items():
            for k in range(blocks[s]):
                first, base, weight, frame, turn = [p for p in phases if p[0] <= k][-1]
                taken.add(base + (k - first) // weight * frame + turn[(k - first) % weight])
        assert taken == set(range(sum(blocks.values())))


def test_mixing(odd_docs, odd_rows, no_docs):
    mixed = mixing.mix(odd_docs, {"s0": 3, "s1": 2, "s2": 1}, block_bytes=64)
    rows = mixed.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r[0], r[1]) for r in odd_rows)
    size = lambda t: max(1, len((t or "").encode())) if t is not None else 1
    for source in {r["source"] for r in rows}:
        own = sorted((r for r in rows if r["source"] == source), key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(size(x["text"]) for x in own[:i]) for i in range(len(own))]
        assert [r["slot"] for r in own] == sorted(r["slot"] for r in own) and all(r["block"] == r["offset"] // 64 for r in own)
    assert len(mixing.in_order(mixed).collect()) == len(rows) and mixing.mix(no_docs).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd_docs, {"s0": 0})


def test_sharding(odd_docs, odd_rows, no_docs, tmp_path):
    got = external_shuffle(odd_docs, 7).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in odd_rows)
    slots = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(7)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert external_shuffle(no_docs, 7).count() == 0 and external_shuffle(odd_docs.limit(2), 7).count() == 2
    written = write_shards(odd_docs, f"file://{tmp_path}/shards", 7)
    assert written.count() == len(odd_rows) and len(list((tmp_path / "shards").glob("shard=*"))) == 7


def test_shards_follow_from_seed_and_rows_alone(spark, monkeypatch):
    monkeypatch.setattr("mediasift.llm.sharding.BUCKET_ROWS", 40)
    rows = [(i, f"text {i % 90}", {"k": i % 2}) for i in range(300)] + [(7, "again", {"k": 0})] * 150 + [(None, None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, extra map<string,int>")
    got = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, splits in ((3, 1), (8, 5), (211, 13)):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got.append(sorted(map(str, external_shuffle(df.repartition(splits), 7).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)
    assert {r["shard"] for r in external_shuffle(df, 7).filter("text = 'again'").collect()} == set(range(7))
    assert sorted(map(str, external_shuffle(df, 7, seed=18).collect())) != got[0]


def test_lm_scoring(spark, odd_docs, odd_rows, no_docs, monkeypatch):
    monkeypatch.setattr("mediasift.llm.lm_score.FLUSH_TOKENS", 500)
    monkeypatch.setattr("mediasift.llm.lm_score.OFTEN", 3)
    learn = F.coalesce(F.col("doc_id") % 3 != 1, F.lit(True))
    model = lm_score.fit(odd_docs, learn)
    got = lm_score.score(odd_docs, model).toPandas()
    tokens = [[*(r[1] or "").encode().lower().split(), None] for r in odd_rows]
    pairs, single = Counter(), Counter()
    for r, t in zip(odd_rows, tokens, strict=True):
        if r[0] is None or r[0] % 3 != 1:
            single.update(t)
            pairs.update(zip(["<s>", *t[:-1]], t, strict=True))
    before, total, vocabulary = Counter(w for _, w in pairs), sum(single.values()), len(single)
    of = lambda c: lm_score.discounts(*[sum(x == k for x in c.values()) for k in (1, 2, 3, 4)])
    d2, d1 = of(pairs), of(before)
    rest1 = sum(d1[min(n, 3)] for n in before.values()) / sum(before.values())
    after, kinds = Counter(), {}
    for (h, _), c in pairs.items():
        after[h] += c
        kinds.setdefault(h, []).append(min(c, 3))

    def p(h, w):
        low = max(before[w] - d1[min(before[w], 3)], 0) / sum(before.values()) + rest1 / (vocabulary + 1)
        if not after[h]:
            return low
        c = pairs[h, w]
        return max(c - d2[min(c, 3)], 0) / after[h] + sum(d2[k] for k in kinds[h]) / after[h] * low

    want = Counter()
    for r, t in zip(odd_rows, tokens, strict=True):
        score = sum(np.log10(p(h, w)) for h, w in zip(["<s>", *t[:-1]], t, strict=True))
        base = sum(np.log10((single[w] + 0.5) / (total + 0.5 * (vocabulary + 1))) for w in t)
        want[(r[0], len(t), sum(single[w] > 0 for w in t), round(base, 6), round(score, 6))] += 1
    assert Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got.itertuples()) == want
    everything = [w for w in single] + [b"never seen"]
    assert sum(p("<s>", w) for w in everything) == pytest.approx(1)
    assert lm_score.score(no_docs, lm_score.fit(no_docs)).count() == 0
    assert lm_score.score(odd_docs, lm_score.fit(no_docs)).agg(F.min("score")).first()[0] == pytest.approx(0)


def test_lm_split_contexts_score_alike(odd_docs, monkeypatch):
    plain = {r["doc_id"]: r["score"] for r in lm_score.score(odd_docs, lm_score.fit(odd_docs)).collect()}
    monkeypatch.setattr("mediasift.llm.lm_score.HOT_WORDS", 0)
    fewer = {r["doc_id"]: r["score"] for r in lm_score.score(odd_docs, lm_score.fit(odd_docs)).collect()}
    assert plain == pytest.approx(fewer)


def test_licences(spark, odd_docs, no_docs):
    scanner = Scanner()
    pool = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "é", "x1"]
    rng = np.random.default_rng(9)
    for _ in range(2000):
        t = [w.encode() for w in rng.choice(pool, rng.integers(0, 12))]
        ((base, _),) = scanner.scan_batch([t])
        assert sorted(base) == sorted((i, k) for k, p in enumerate(PHRASES) for i in range(len(t)) if t[i : i + len(p.split())] == [x.encode() for x in p.split()])
    texts = [b" " + b" ".join(words(x)) + b" " for v in TEMPLATES.values() for x in v] + [b" " + p.encode() + b" " for p in PHRASES]
    for _ in range(60):
        a, b = (words(rng.choice([x for v in TEMPLATES.values() for x in v])) for _ in range(2))
        t = a[3:9] + [b"x1"] + b[: int(rng.integers(0, 8))]
        got = [n for _, n in scanner.automaton.statistics([scanner.ids[w] for w in t])]
        for i, n in enumerate(got):
            assert n == max((k for k in range(1, i + 2) if any(b" " + b" ".join(t[i + 1 - k : i + 1]) + b" " in x for x in texts)), default=0)
    doc = "intro. " + TEMPLATES["mit"][0] + " outro, cc-by MIT License; " + TEMPLATES["bsd"][0]
    rows = spark.createDataFrame([(1, doc), (2, None), (3, "nothing of the kind is granted here")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in scan_licences(rows).collect()}
    assert (got[1]["base_labels"], got[1]["labels"], got[1]["n_base"], got[1]["score"]) == ("cc-by,mit", "bsd,cc-by,mit", 2, 1.0)
    assert got[1]["spans"][0]["first_word"] == 1 and got[1]["spans"][0]["covered"] == 1.0
    assert (got[2]["n_words"], got[2]["labels"], got[3]["labels"], got[3]["first_word"]) == (0, "", "", None)
    assert scan_licences(odd_docs).count() == odd_docs.count() and scan_licences(no_docs).count() == 0


def test_generic_openings_carry_no_label():
    by, lgpl = "Creative Commons Attribution{} {} License.", "GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    cases = {
        "This work is licensed under the terms of the house.": set(),
        "This work is licensed under a Creative Commons licence of some kind": set(),
        "This work is licensed under the " + by.format("-ShareAlike", "4.0 International"): {"cc-by-sa"},
        "This work is licensed under a " + by.format("-NoDerivatives", "4.0 International"): {"cc-by-nd"},
        "This work is licensed under a " + by.format("-NonCommercial-ShareAlike", "3.0 Unported"): {"cc-by-nc-sa"},
        "This work is licensed under a " + by.format("", "3.0 Unported"): {"cc-by"},
        "This program is free software: you can redistribute it and/or modify it under the terms of the " + lgpl: {"lgpl"},
        **{text: {label} for label, texts in TEMPLATES.items() for text in texts},
    }
    found = Scanner().scan_batch([words(text) for text in cases])
    assert [{s[0] for s in spans} for _, spans in found] == list(cases.values())


def brute_spans(scanner, doc):
    """Chains by the definition, from maximal matches found by comparing word lists."""
    texts = [words(x) for v in TEMPLATES.values() for x in v]
    places = lambda part, t: [i for i in range(len(t) - len(part) + 1) if t[i : i + len(part)] == part]
    spoken = texts + [words(p) for p in PHRASES]
    longest = [next((n for n in range(min(i + 1, 400), 0, -1) if any(places(doc[i + 1 - n : i + 1], t) for t in spoken)), 0) for i in range(len(doc))]
    spans = []
    for k, t in enumerate(texts):
        chain = None
        for i, n in enumerate(longest):
            if n < 5 or (i + 1 < len(doc) and longest[i + 1] == n + 1):
                continue
            part, start = doc[i + 1 - n : i + 1], i + 1 - n
            if not (at := places(part, t)):
                continue
            told = len({scanner.labels[j] for j, x in enumerate(texts) if places(part, x)}) == 1
            later = [x for x in at if chain and x + max(0, chain[1] - start) >= chain[2]]
            if chain and chain[1] - start >= n:
                continue
            if chain and start - chain[1] <= 8 and later:
                chain = [chain[0], i + 1, later[0] + n, chain[3] + n - max(0, chain[1] - start), chain[4] or told]
                continue
            spans += [(k, *chain)] if chain else []
            chain = [start, i + 1, at[0] + n, n, told]
        spans += [(k, *chain)] if chain else []
    return sorted((scanner.labels[k], first, after - 1, round(covered / len(texts[k]), 9)) for k, first, after, _, covered, told in spans if told and covered / len(texts[k]) >= 0.5)


def test_spans_against_brute_force():
    scanner, rng = Scanner(), np.random.default_rng(12)
    texts = [words(x) for v in TEMPLATES.values() for x in v]
    docs = []
    for _ in range(25):
        doc = []
        for t in (texts[i] for i in rng.integers(0, len(texts), 2)):
            t = list(t)
            for i in np.flatnonzero(rng.random(len(t)) < rng.choice([0, 0.03, 0.1])):
                t[i] = b"changed"
            doc += t[int(rng.integers(0, 4)) :] + [b"x"] * int(rng.integers(0, 12))
        docs.append(doc)
    bsd = list(words(TEMPLATES["bsd"][0]))
    bsd[8::9] = [b"changed"] * len(bsd[8::9])
    docs.append(bsd)  # repeats itself: a chain must find its later places
    found = [spans for _, spans in scanner.scan_batch(docs)]
    assert [sorted((a, b, c, round(d, 9)) for a, b, c, d in spans) for spans in found] == [brute_spans(scanner, d) for d in docs]
    assert found[-1][0][0] == "bsd" and found[-1][0][3] > 0.85


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))


def test_leaves_of_a_fingerprint_follow_from_rows_not_only_from_pairs(spark, monkeypatch):
    from mediasift.llm import simhash

    seen = []
    monkeypatch.setattr(simhash, "leaves", lambda fp, masks, *rest: seen.append(len(masks)) or leaves(fp, masks, *rest))
    for n in (40_000, 160_000):  # one row more a fingerprint costs more than the pairs that it saves
        points = spark.range(n).select(F.xxhash64("id").alias("fp"), F.col("id").alias("rep"))
        link_forest(points)
    assert seen == [4, 4]
