"""The operators of this subpackage as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.llm import language, lm_score
from mediasift.llm.centroids import cluster_vectors
from mediasift.llm.exact_dedup import duplicate_groups
from mediasift.llm.licences import scan_licences
from mediasift.llm.mixing import mix
from mediasift.llm.packing import pack_documents
from mediasift.llm.resampling import resample
from mediasift.llm.sentence_pieces import decode_pieces, encode_pieces
from mediasift.llm.sharding import external_shuffle
from mediasift.llm.simhash import near_duplicates
from mediasift.llm.token_files import token_documents
from mediasift.llm.vector_dedup import near_vectors

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), 1024, 2)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_documents(table(spark, sf_dir, "documents"), tokenizer_path(), 0)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents"), digest_all=True)


def remainder(divisor: int) -> Column:
    """crc32(doc_id as text) mod divisor."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(divisor))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder(3) == 1, F.lit(False))
    found = language.identify(docs, language.fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "block", "slot", "offset")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shuffled = external_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long") + 16
    return shuffled.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder(5) == 1, F.lit(False))
    model = lm_score.fit(docs, ~held_out)
    found = lm_score.score(docs, model)
    model.remove(docs)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents")).drop("spans")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster_vectors(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path(PIECES)
    coded = encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), model).select("doc_id", "ids")
    found = decode_pieces(coded, model)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
h AS (SELECT doc_id, n, sha256(t) AS text_sha256 FROM d)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept,
       text_sha256
FROM h
"""


OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CASE WHEN vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      THEN embedding::DOUBLE[] ELSE []::DOUBLE[] END AS e FROM embeddings),
u AS (SELECT vec_id, e, len(e) AS dim, sqrt(list_dot_product(e, e)) AS norm FROM v),
p AS (SELECT row_number() OVER () AS r, * FROM u WHERE norm > 0),
k AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.dim = b.dim AND a.r <> b.r AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
n AS (SELECT a, count(*) AS n FROM k GROUP BY a),
reach AS (SELECT vec_id AS a, vec_id AS c FROM p UNION SELECT reach.a, k.b FROM reach JOIN k ON k.a = reach.c),
m AS (SELECT a, min(c) AS c FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(m.c, vec_id) AS component_id, vec_id = coalesce(m.c, vec_id) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id
"""


#: CRC-32 is linear in a feature's bytes: each byte adds the value of its place from the end, and each length a start value.
OP11_SQL = r"""
WITH RECURSIVE byte AS (SELECT range AS b, list_reduce([range, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256)),
words AS MATERIALIZED (SELECT r, doc_id, kind, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT row_number() OVER () AS r, doc_id, 's' AS kind, text FROM documents UNION ALL SELECT row_number() OVER (), NULL, 't', text FROM benchmark)),
runs AS (SELECT r, kind, array_to_string(w[i + 1 : i + n], ' ') AS f FROM words, (VALUES (1), (2), (3)) t(n), unnest(range(len(w) - n + 1)) u(i)),
counted AS MATERIALIZED (SELECT r, kind, f, count(*) AS n FROM runs GROUP BY ALL),
feature AS MATERIALIZED (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)),
longest AS (SELECT max(length(h) // 2) AS n FROM feature),
place(k, b, v) AS (SELECT 0, b, v FROM byte UNION ALL SELECT k + 1, p.b, xor(p.v >> 8, byte.v) FROM place p JOIN byte ON byte.b = p.v & 255 WHERE k + 1 < (SELECT n FROM longest)),
start(n, v) AS (SELECT 0, 4294967295 UNION ALL SELECT start.n + 1, xor(start.v >> 8, byte.v) FROM start JOIN byte ON byte.b = start.v & 255 WHERE start.n < (SELECT n FROM longest)),
bytes AS (SELECT f, length(h) // 2 - 1 - i AS k, substr(h, 2 * i + 1, 2) AS x FROM feature, unnest(range(length(h) // 2)) u(i)),
linear AS (SELECT f, bit_xor(v) AS v FROM bytes JOIN (SELECT k, v, printf('%02X', b) AS x FROM place) USING (k, x) GROUP BY f),
bucket AS MATERIALIZED (SELECT f, xor(xor(linear.v, start.v), 4294967295) % 10000 AS b FROM linear JOIN feature USING (f) JOIN start ON start.n = length(h) // 2),
part AS MATERIALIZED (SELECT r, kind, b, sum(n) AS n FROM counted JOIN bucket USING (f) GROUP BY ALL),
share AS (SELECT b, coalesce(sum(n) FILTER (kind = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 't'), 0)::DOUBLE AS t FROM part GROUP BY b),
whole AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM share),
gain AS (SELECT b, floor(1000 * ln((share.t + 1) * (whole.s + 10000) / ((share.s + 1) * (whole.t + 10000))))::BIGINT AS g FROM share, whole),
weight AS (SELECT r, sum(n * g) AS total FROM part JOIN gain USING (b) WHERE kind = 's' GROUP BY r),
scored AS (SELECT words.r, doc_id, len(w) AS n_words, coalesce(weight.total, 0)::BIGINT AS weight,
  coalesce(weight.total, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weight USING (r) WHERE kind = 's'),
drawn AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, (n_words + greatest(n_words - 1, 0) + greatest(n_words - 2, 0))::BIGINT AS n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN drawn USING (r)
"""


def op12_sql(k: int = 40, rounds: int = 5) -> str:
    """Every round as two steps of one query: nearest centroids, then their means."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS MATERIALIZED (SELECT r, c, sum((p.x - q.x) * (p.x - q.x)) AS d FROM parts p JOIN c{i} q USING (i) GROUP BY r, c),
n{i} AS MATERIALIZED (SELECT r, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM d{i} GROUP BY r)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT q.c, q.i, coalesce(m.x, q.x) AS x FROM c{i} q LEFT JOIN
  (SELECT n.c, p.i, ((sum(p.x) - ((sum(p.x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM n{i} n JOIN parts p USING (r) GROUP BY ALL) m USING (c, i))""")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, i, floor(256 * e[i]::DOUBLE)::BIGINT AS x FROM kept, range(1, 65) t(i)),
first AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), vec_id, e) - 1 AS c FROM kept QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT c, i, x FROM parts JOIN first USING (r)),
{{}},
about AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS digest FROM c{rounds} GROUP BY c),
inertia AS (SELECT c, sum(d) AS own, sum(sum(d)) OVER () AS whole FROM n{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, own::BIGINT AS cluster_inertia, whole::BIGINT AS inertia, digest AS centroid_sha256
FROM kept JOIN n{rounds} USING (r) JOIN about USING (c) JOIN inertia USING (c)
""".format(",\n".join(steps))


def queries() -> dict[str, Query]:
    found = [op1_best_fit_packing, op2_embedding_near_dedup, op3_token_files, op4_exact_dedup, op5_language_id, op6_simhash_near_dedup, op7_source_mixing, op8_sharding, op9_lm_scoring, op10_licence_scan, op11_importance_resampling, op12_centroid_clustering, op13_sentence_pieces]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_near_dedup": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op11_importance_resampling": OP11_SQL, "op12_centroid_clustering": op12_sql()}
