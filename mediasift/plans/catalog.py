"""Named queries over the driver's tables, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.functions import columns as c
from mediasift.functions.jpeg import encode_jpeg
from mediasift.operators import cache, detections, engines, frames, learning, matching, routing, runtime, scores, text
from mediasift.operators.table_functions import register_engines
from mediasift.operators.verdict import Settings, fold
from mediasift.plans import fixtures as fx
from mediasift.scratch import materialise, scratch
from mediasift.sources import store
from mediasift.sources.lists import parse_hash_lines
from mediasift.streaming import cache_state

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL it must agree with."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- hash lists -------------------------------------------------------------------------------------------------

NEAR = "SELECT h.media_id, min(struct_pack(d := bit_count(xor(h.bits, bl.bits))::INT, n := bl.line_no, l := bl.label)) AS b FROM h JOIN bl ON bit_count(xor(h.bits, bl.bits)) <= {r} GROUP BY h.media_id"
FLAGSHIP_SQL = f"""
WITH {fx.HASHES_SQL}, near AS ({NEAR.format(r=6)}),
ex AS (SELECT bits, max(line_no) AS n, max_by(label, line_no) AS l FROM al GROUP BY bits)
SELECT h.media_id, CASE WHEN near.b IS NOT NULL THEN 'BLOCK' WHEN ex.n IS NOT NULL THEN 'OK' ELSE 'OK' END AS label,
       CASE WHEN near.b IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS risk,
       near.b.d AS block_distance, near.b.l AS block_label, ex.l AS allow_label, (near.b IS NOT NULL OR ex.n IS NOT NULL) AS settled
FROM h LEFT JOIN near USING (media_id) LEFT JOIN ex ON h.bits = ex.bits
"""


@query(FLAGSHIP_SQL)
def flagship_hash_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash, nearest block entry, exact allow entry, verdict."""
    h = fx.hashes(spark, sf_dir)
    near = matching.nearest_match(h, fx.block_list(h), 6)
    exact = matching.exact_match(h.select("media_id", "bits"), fx.allow_list(h))
    both = exact.join(near.select("media_id", F.col("distance").alias("block_distance"), F.col("match_label").alias("block_label")), "media_id", "left")
    blocked = F.col("block_distance").isNotNull()
    return both.select("media_id", F.when(blocked, "BLOCK").otherwise("OK").alias("label"), F.when(blocked, 1.0).otherwise(0.0).alias("risk"), "block_distance", "block_label", F.col("match_label").alias("allow_label"), (blocked | F.col("match_line").isNotNull()).alias("settled"))


@query(f"WITH {fx.HASHES_SQL} SELECT h.media_id, al.line_no AS match_line, al.label AS match_label FROM h LEFT JOIN (SELECT bits, max(line_no) AS line_no, max_by(label, line_no) AS label FROM al GROUP BY bits) al USING (bits)")
def hash_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = fx.hashes(spark, sf_dir)
    return matching.exact_match(h.select("media_id", "bits"), fx.allow_list(h)).select("media_id", "match_line", "match_label")


@query(f"WITH {fx.HASHES_SQL}, two AS (SELECT line_no, label, bits FROM bl UNION ALL SELECT line_no + 1000000, 'late ' || label, bits FROM bl) SELECT bits, max_by(label, line_no) AS label, max(line_no) AS line_no FROM two GROUP BY bits")
def hash_exact_last_dup_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fx.block_list(fx.hashes(spark, sf_dir))
    late = b.select((F.col("line_no") + 1_000_000).alias("line_no"), F.concat(F.lit("late "), "label").alias("label"), "bits")
    return matching.last_entries(b.unionByName(late))


NEAR_SQL = f"WITH {fx.HASHES_SQL}, near AS ({NEAR}) SELECT media_id, b.d AS distance, b.n AS match_line, b.l AS match_label FROM near"


@query(NEAR_SQL.format(r=6))
def hash_hamming_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = fx.hashes(spark, sf_dir)
    return matching.nearest_match(h, fx.block_list(h), 6)


@query(NEAR_SQL.format(r=24))
def hash_hamming_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = fx.hashes(spark, sf_dir)
    return matching.nearest_match(h, fx.block_list(h), 24)


@query(NEAR_SQL.format(r=6))
def hash_hamming_banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by wide keys and a shuffled list."""
    h = fx.hashes(spark, sf_dir)
    return matching.nearest_match(h, fx.block_list(h), 6, together=3, broadcast_rows=0)


@query(f"WITH {fx.HASHES_SQL} SELECT media_id, printf('%016x', v::UBIGINT) AS hex, bits AS back FROM u JOIN h USING (media_id)")
def hash_hex_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = fx.hashes(spark, sf_dir)
    return h.select("media_id", c.hex_of_bits(F.col("bits")).alias("hex")).withColumn("back", c.bits_of_hex(F.upper("hex")))


TWO_SQL = f"""
WITH {fx.HASHES_SQL}, p AS (SELECT media_id, bits AS f, xor(bits, 85::BIGINT) AS l FROM h),
q AS (SELECT media_id, 0 AS side, f AS bits FROM p UNION ALL SELECT media_id, 1, l FROM p),
g AS (SELECT q.media_id, min(struct_pack(d := bit_count(xor(q.bits, bl.bits))::INT, s := q.side, n := bl.line_no, l := bl.label)) AS b FROM q JOIN bl ON bit_count(xor(q.bits, bl.bits)) <= 6 GROUP BY q.media_id)
SELECT media_id, b.d AS distance, CASE WHEN b.s = 0 THEN 'first' ELSE 'last' END AS matched_on, b.n AS match_line, b.l AS match_label FROM g
"""


@query(TWO_SQL)
def hash_first_last_frame_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = fx.hashes(spark, sf_dir)
    pair = h.select("media_id", F.col("bits").alias("first"), F.col("bits").bitwiseXOR(F.lit(85).cast("bigint")).alias("last"))
    return matching.nearest_of_two(pair, fx.block_list(h), 6)


@query(f"WITH {fx.HASHES_SQL}, near AS ({NEAR.format(r=6)}), ex AS (SELECT DISTINCT bits FROM al) SELECT h.media_id, CASE WHEN near.b IS NOT NULL THEN 'BLOCK' WHEN ex.bits IS NOT NULL THEN 'OK' END AS label, CASE WHEN near.b IS NOT NULL THEN 1.0::DOUBLE WHEN ex.bits IS NOT NULL THEN 0.0::DOUBLE END AS risk, CASE WHEN near.b IS NOT NULL THEN near.b.d WHEN ex.bits IS NOT NULL THEN 0 END AS distance FROM h LEFT JOIN near USING (media_id) LEFT JOIN ex ON h.bits = ex.bits")
def hash_short_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = fx.hashes(spark, sf_dir)
    near = matching.nearest_match(h, fx.block_list(h), 6).select("media_id", F.col("distance").alias("block_distance"))
    found = matching.exact_match(h.select("media_id", "bits"), fx.allow_list(h)).join(near, "media_id", "left")
    return matching.settle_by_lists(found.select("media_id", F.col("block_distance").isNotNull().alias("blocked"), "block_distance", F.col("match_line").isNotNull().alias("allowed"), F.lit(0).alias("allow_distance")))


@query("WITH n AS (SELECT md5(text)[1:16] AS hex, min(lang) AS label FROM documents GROUP BY 1), l AS (SELECT DISTINCT md5(text)[1:16] AS hex FROM benchmark) SELECT hex, label FROM n WHERE hex NOT IN (SELECT hex FROM l)")
def hash_list_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = fx.table(spark, sf_dir, "documents").select(F.upper(F.substring(F.md5("text"), 1, 16)).alias("hex"), F.col("lang").alias("label"))
    have = fx.table(spark, sf_dir, "benchmark").select(F.substring(F.md5("text"), 1, 16).alias("hex"))
    return matching.insert_if_absent(new, have)


LINES_SQL = """
WITH l AS (SELECT doc_id AS line_no, CASE doc_id % 6 WHEN 0 THEN '# ' || md5(text) WHEN 1 THEN upper(md5(text)[1:16]) || ', ' || lang || chr(13) WHEN 2 THEN md5(text)[1:12] || ',' WHEN 3 THEN '  ' || md5(text)[1:16] || '  ' WHEN 4 THEN 'xyz' || md5(text) ELSE chr(13) END AS t FROM documents),
p AS (SELECT line_no, trim(regexp_replace(t, '[\r\n]+$', '')) AS t FROM l),
q AS (SELECT line_no, lower(trim(split_part(t, ',', 1))) AS hex, nullif(trim(CASE WHEN contains(t, ',') THEN t[strpos(t, ',') + 1:] ELSE '' END), '') AS g, t FROM p)
SELECT line_no, hex, coalesce(g, 'block') AS label, length(hex)::INT AS hex_len FROM q WHERE t <> '' AND t NOT LIKE '#%' AND regexp_full_match(hex, '[0-9a-f]+')
"""


@query(LINES_SQL)
def list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, h = fx.table(spark, sf_dir, "documents"), F.md5("text")
    k = F.col("doc_id") % 6
    line = F.when(k == 0, F.concat(F.lit("# "), h)).when(k == 1, F.concat(F.upper(F.substring(h, 1, 16)), F.lit(", "), "lang", F.lit("\r"))).when(k == 2, F.concat(F.substring(h, 1, 12), F.lit(","))).when(k == 3, F.concat(F.lit("  "), F.substring(h, 1, 16), F.lit("  "))).when(k == 4, F.concat(F.lit("xyz"), h)).otherwise("\r")
    return parse_hash_lines(d, F.col("doc_id"), line, "block").drop("bits")


#: Frames of an item: its hash, and the hash with up to three bits changed.
LAST_BITS = "xor(bits, (1::BIGINT << (media_id % 4)::INT) - 1)"
DETAILS_SQL = """SELECT f.media_id, 'ok' AS status, CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score, {hex} AS match_hex, lab AS match_label, d::VARCHAR AS distance, w AS matched_on,
  printf('%016x', CASE WHEN f < 0 THEN f::HUGEINT + 18446744073709551616 ELSE f END::UBIGINT) AS first, printf('%016x', CASE WHEN l < 0 THEN l::HUGEINT + 18446744073709551616 ELSE l END::UBIGINT) AS last FROM f LEFT JOIN b USING (media_id)"""
HIT_HEX = "printf('%016x', CASE WHEN e < 0 THEN e::HUGEINT + 18446744073709551616 ELSE e END::UBIGINT)"


def _list_details(spark: SparkSession, sf_dir: str, engine: Callable[[DataFrame], engines.Engine], score: str) -> DataFrame:
    h = fx.hashes(spark, sf_dir)
    media = h.select("media_id", F.col("bits").alias("first"), F.col("bits").bitwiseXOR(F.expr("shiftleft(1L, cast(media_id % 4 as int)) - 1")).alias("last"))
    found = engine(h).results(media)
    return found.select("media_id", "status", F.col("scores")[score].alias("score"), *[F.try_element_at("details", F.lit(k)).alias(k) for k in ("match_hex", "match_label", "distance", "matched_on", "first", "last")])


@query(f"WITH {fx.HASHES_SQL}, f AS (SELECT media_id, bits AS f, {LAST_BITS} AS l FROM h), s AS (SELECT media_id, 0 AS side, f AS x FROM f UNION ALL SELECT media_id, 1, l FROM f), c AS (SELECT s.media_id, min(struct_pack(d := bit_count(xor(x, bl.bits))::INT, s := side, n := line_no, l := bl.label, e := bl.bits)) AS b FROM s JOIN bl ON bit_count(xor(x, bl.bits)) <= 6 GROUP BY 1), b AS (SELECT media_id, b.n AS n, b.d AS d, b.l AS lab, b.e AS e, CASE b.s WHEN 0 THEN 'first' ELSE 'last' END AS w FROM c) {DETAILS_SQL.format(hex=f'CASE WHEN n IS NOT NULL THEN {HIT_HEX} END')}")
def engine_blocklist_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block list engine on first and last frames, with all that it tells."""
    return _list_details(spark, sf_dir, lambda h: engines.blocklist_engine(fx.block_list(h), 6), "phash_block_match")


@query(f"WITH {fx.HASHES_SQL}, f AS (SELECT media_id, bits AS f, {LAST_BITS} AS l FROM h), a AS (SELECT bits, max(line_no) AS n, max_by(label, line_no) AS lab FROM al GROUP BY bits), b AS (SELECT media_id, coalesce(x.n, y.n) AS n, coalesce(x.lab, y.lab) AS lab, CASE WHEN x.n IS NOT NULL OR y.n IS NOT NULL THEN 0 END AS d, coalesce(x.bits, y.bits) AS e, CASE WHEN x.n IS NOT NULL THEN 'first' WHEN y.n IS NOT NULL THEN 'last' END AS w FROM f LEFT JOIN a x ON x.bits = f LEFT JOIN a y ON y.bits = l) {DETAILS_SQL.format(hex=f'CASE WHEN n IS NOT NULL THEN {HIT_HEX} END')}")
def engine_allowlist_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The allow list engine on first and last frames, by equal hashes."""
    return _list_details(spark, sf_dir, lambda h: engines.allowlist_engine(fx.allow_list(h)), "phash_allow_match")


# ---- frames -----------------------------------------------------------------------------------------------------

SAMPLE_SQL = """
WITH f AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn FROM f WHERE n <= {s} OR turn IN (SELECT unnest([round_even(j * (n - 1) / {k}.0, 0)::BIGINT for j in range({s})]))
"""


@query(SAMPLE_SQL.format(s=4, k=3))
def frame_sample_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.even_sample(fx.table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn", 4)


@query(SAMPLE_SQL.format(s=12, k=11))
def frame_sample_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.even_sample(fx.table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn", 12)


@query("SELECT conv_id, turn FROM conversations")
def frame_sample_all_when_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.even_sample(fx.table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn", 1)


@query("SELECT conv_id, min_by(role, turn) AS first, max_by(role, turn) AS last, min(turn) = max(turn) AS single FROM conversations GROUP BY conv_id")
def frame_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.first_and_last(fx.table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2")
def frame_first_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.first_k(fx.table(spark, sf_dir, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn", "role")


# ---- images -----------------------------------------------------------------------------------------------------

#: Mean difference of a tile's pixels that a payload of the usual quality may make.
NEAR_PIXELS = 6


@query("SELECT vec_id, 64 AS width, 64 AS height, 3 AS n_channels, true AS near FROM embeddings")
def jpeg_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as tiles of 8 x 8 grey pixels, 64 to an image, written as JPEG payloads and read back by the image source."""
    folder = scratch(spark, "jpeg")
    grey = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.greatest(F.lit(0), F.least(F.lit(255), F.round(128 + 400 * F.coalesce(F.get("embedding", i), F.lit(0.0))).cast("int"))))
    tiles = fx.table(spark, sf_dir, "embeddings").select("vec_id", grey.alias("tile"))
    pages = tiles.groupBy(F.floor(F.col("vec_id") / 64).alias("page")).agg(F.collect_list(F.struct((F.col("vec_id") % 64).cast("int").alias("at"), "tile")).alias("tiles"))  # 64 tiles a page

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store._open(folder)
        files.create_dir(root)
        for b in batches:
            for page, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                image = np.zeros((8, 8, 8, 8), np.uint8)  # row of tiles, row of pixels, tile, pixel
                for t in found:
                    image[t["at"] // 8, :, t["at"] % 8] = np.array(t["tile"]).reshape(8, 8)
                with files.open_output_stream(f"{root}/{page}.jpg") as out:
                    out.write(encode_jpeg(image.reshape(64, 64)))
            yield pa.RecordBatch.from_arrays([b.column(0)], ["page"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pixels = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, 8, 8, 8, 8, 3)[..., 1].transpose(0, 1, 3, 2, 4).reshape(-1, 64)
            ids = (np.array(b.column(0).to_pylist(), np.int64).reshape(-1, 1) * 64 + np.arange(64)).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(pixels.astype(np.int32)))], ["vec_id", "read"])

    materialise(pages.mapInArrow(write, "page long"), "pages")
    images = spark.read.format("image").load(folder).select(F.regexp_extract("image.origin", r"(-?\d+)\.jpg$", 1).cast("long").alias("page"), "image.*")
    read = images.select("page", "data").mapInArrow(cut, "vec_id long, read array<int>")
    sizes = images.agg(F.min("width").alias("width"), F.max("height").alias("height"), F.max("nChannels").alias("n_channels"))
    apart = F.aggregate(F.zip_with("tile", "read", lambda a, b: F.abs(a - b)), F.lit(0), lambda a, b: a + b) / 64
    return tiles.join(read, "vec_id").crossJoin(F.broadcast(sizes)).select("vec_id", "width", "height", "n_channels", (apart <= NEAR_PIXELS).alias("near"))  # one row of sizes


# ---- text -------------------------------------------------------------------------------------------------------

PATTERNS = ["license", "token\\s*=", "worthless|stupid", "the"]


def _hit_sql(column: str, patterns: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}', 'i') THEN '{p}'" for p in patterns) + " END"


@query(f"SELECT doc_id, CASE WHEN {_hit_sql('text', PATTERNS)} IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ocr_match, {_hit_sql('text', PATTERNS)} AS hit FROM documents")
def text_blocklist_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.text_check(fx.table(spark, sf_dir, "documents"), "doc_id", "text", PATTERNS)


FRAMED_SQL = "SELECT doc_id, chr(10) || chr(9) || left(text, (doc_id % 8)::INT) || chr(13) || chr(10) || ' ' AS t FROM documents"


@query(f"WITH f AS ({FRAMED_SQL}), s AS (SELECT doc_id, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS t FROM f) SELECT doc_id, CASE WHEN length(t) >= 4 AND regexp_matches(t, '[a-z]', 'i') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ocr_match, CASE WHEN length(t) >= 4 AND regexp_matches(t, '[a-z]', 'i') THEN '[a-z]' END AS hit, CASE WHEN length(t) >= 4 THEN t[:5] ELSE '' END AS text FROM s")
def text_min_len_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts between line breaks and blanks, which don't count."""
    framed = F.concat(F.lit("\n\t"), F.expr("left(text, cast(doc_id % 8 as int))"), F.lit("\r\n "))
    return text.text_check(fx.table(spark, sf_dir, "documents").select("doc_id", framed.alias("text")), "doc_id", "text", ["[a-z]"], 4, shown=5)


WORD_PAIRS_SQL = "SELECT DISTINCT w[i] AS a, w[i + 1] AS b FROM (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark), unnest(range(1, len(w))) t(i)"


@query(f"WITH p AS (SELECT row_number() OVER (ORDER BY a, b) AS n, a || '\\s+(?:' || b || ')' AS p FROM ({WORD_PAIRS_SQL})), m AS (SELECT doc_id, min_by(p, n) AS hit FROM documents, p WHERE regexp_matches(lower(text), p) GROUP BY doc_id) SELECT doc_id, CASE WHEN hit IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS ocr_match, hit FROM documents LEFT JOIN m USING (doc_id)")
def text_first_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of all pairs of neighbouring benchmark words, some thousands of patterns, searched at once."""
    words = fx.table(spark, sf_dir, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("w"))
    pairs = words.select(F.explode(F.arrays_zip(F.expr("slice(w, 1, greatest(size(w) - 1, 0))").alias("a"), F.expr("slice(w, 2, greatest(size(w) - 1, 0))").alias("b"))).alias("p"))
    listed = [rf"{r['a']}\s+(?:{r['b']})" for r in pairs.select("p.*").distinct().orderBy("a", "b").collect()]  # a list file, as it would be read
    return text.text_check(fx.table(spark, sf_dir, "documents"), "doc_id", "text", listed)


@query(f"SELECT coalesce({_hit_sql('text', PATTERNS)}, '-') AS hit, count(*) AS docs FROM documents GROUP BY 1")
def text_hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.text_check(fx.table(spark, sf_dir, "documents"), "doc_id", "text", PATTERNS)
    return found.groupBy(F.coalesce("hit", F.lit("-")).alias("hit")).agg(F.count("*").alias("docs"))


@query(f"WITH j AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (text <> '') AS t FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2) GROUP BY conv_id) SELECT conv_id, md5(coalesce(t, '')) AS text_md5, {_hit_sql('t', PATTERNS)} AS hit FROM j")
def text_of_first_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = frames.first_k(fx.table(spark, sf_dir, "conversations"), "conv_id", "turn", 2)
    joined = text.joined_texts(first, "conv_id", "turn", "text")
    return joined.select("conv_id", F.md5("text").alias("text_md5"), text.first_hit(F.col("text"), PATTERNS).alias("hit"))


# ---- names, files and knobs -------------------------------------------------------------------------------------


@query("SELECT page_id, regexp_matches(url, '^[hH][tT][tT][pP][sS]?://[^/?#]+') AS is_url, regexp_matches(substr(url, 6), '^[hH][tT][tT][pP][sS]?://[^/?#]+') AS cut_is_url FROM pages")
def url_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "pages").select("page_id", c.is_url(F.col("url")).alias("is_url"), c.is_url(F.substring("url", 6, 10000)).alias("cut_is_url"))


EXT_CHOICES = [".JPG", ".jpeg", ".png", ".webp", ".GIF", ".bmp", ".tif", ".tiff", ".txt", "", ".svg"]
EXT_SQL = f"WITH p AS (SELECT page_id, url || {EXT_CHOICES}[(page_id % 11 + 1)::INT] AS path FROM pages), e AS (SELECT page_id, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '.(\\.[^.]*)$', 1)) AS ext FROM p) SELECT page_id, ext, ext IN ('.jpg', '.jpeg', '.png', '.webp', '.gif', '.bmp', '.tif', '.tiff') AS is_image FROM e"


@query(EXT_SQL)
def ext_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.table(spark, sf_dir, "pages")
    path = F.concat("url", F.element_at(F.array(*map(F.lit, EXT_CHOICES)), (F.col("page_id") % 11 + 1).cast("int")))
    return p.select("page_id", c.extension(path).alias("ext"), c.is_image_path(path).alias("is_image"))


MIME_SQL = """CASE WHEN ext IN ('.jpg', '.jpeg') THEN 'image/jpeg' WHEN ext = '.png' THEN 'image/png' WHEN ext = '.webp' THEN 'image/webp' WHEN ext = '.gif' THEN 'image/gif'
 WHEN ext = '.bmp' THEN 'image/bmp' WHEN ext IN ('.tif', '.tiff') THEN 'image/tiff' ELSE 'application/octet-stream' END"""


@query(f"SELECT page_id, {MIME_SQL} AS mime FROM ({EXT_SQL})")
def mime_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("url", F.element_at(F.array(*map(F.lit, EXT_CHOICES)), (F.col("page_id") % 11 + 1).cast("int")))
    return fx.table(spark, sf_dir, "pages").select("page_id", c.mime_of_path(path).alias("mime"))


HEADS = ["FFD8FFE0AABBCCDD11223344", "89504E470D0A1A0A00000000", "474946383761010001000000", "474946383961010001000000", "524946460000000057454250", "524946460000000057415645", "00", "FFD8"]
KINDS = ["image/jpeg", "image/jpeg; charset=x", "IMAGE/PNG", "text/html", "", "application/octet-stream", "image/svg+xml"]
HEAD_SQL = f"{HEADS}[(page_id % 8 + 1)::INT]"


@query(f"SELECT page_id, CASE WHEN {HEAD_SQL} LIKE 'FFD8FF%' THEN 'image/jpeg' WHEN {HEAD_SQL} LIKE '89504E470D0A1A0A%' THEN 'image/png' WHEN {HEAD_SQL} LIKE '474946383_61%' THEN 'image/gif' WHEN {HEAD_SQL} LIKE '52494646%57454250' THEN 'image/webp' ELSE '' END AS mime FROM pages")
def magic_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.unhex(F.element_at(F.array(*map(F.lit, HEADS)), (F.col("page_id") % 8 + 1).cast("int")))
    return fx.table(spark, sf_dir, "pages").select("page_id", c.sniff_mime(head).alias("mime"))


FETCH_SQL = f"""
WITH p AS (SELECT page_id, url || ['', '.jpeg', '.png', '?x=.gif'][(page_id % 4 + 1)::INT] AS url, {HEAD_SQL} AS h, lower(trim(split_part({KINDS}[(page_id % 7 + 1)::INT], ';', 1))) AS ct, page_id * 1000000 % 30000000 AS len FROM pages),
s AS (SELECT *, CASE WHEN h LIKE 'FFD8FF%' THEN '.jpg' WHEN h LIKE '89504E470D0A1A0A%' THEN '.png' WHEN h LIKE '474946383_61%' THEN '.gif' WHEN h LIKE '52494646%57454250' THEN '.webp' END AS sx, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM p),
t AS (SELECT *, CASE WHEN ct LIKE 'image/%' THEN CASE ct WHEN 'image/jpeg' THEN '.jpg' WHEN 'image/png' THEN '.png' WHEN 'image/gif' THEN '.gif' WHEN 'image/webp' THEN '.webp' END ELSE sx END AS tx, lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1)) AS px FROM s),
v AS (SELECT *, coalesce(tx, CASE WHEN px IN ('.jpg', '.jpeg') THEN '.jpg' WHEN px IN ('.png', '.webp', '.gif') THEN px END, sx) AS x FROM t),
w AS (SELECT *, CASE WHEN len > 25000000 THEN 'too_large' WHEN ct <> '' AND ct NOT LIKE 'image/%' AND sx IS NULL THEN 'not_an_image' WHEN x IS NULL THEN 'unsupported_format' END AS error, regexp_extract(path, '([^/]*)$', 1) AS base FROM v)
SELECT page_id, error, CASE WHEN error IS NULL THEN x END AS ext, CASE WHEN error IS NULL THEN CASE WHEN base <> '' THEN base ELSE 'downloaded' || x END END AS name FROM w
"""


@query(FETCH_SQL)
def url_fetch_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % n + 1).cast("int"))
    url = F.concat("url", pick(["", ".jpeg", ".png", "?x=.gif"], 4))
    found = c.fetch_decision(url, pick(KINDS, 7), F.unhex(pick(HEADS, 8)), F.col("page_id") * 1_000_000 % 30_000_000, F.lit(None).cast("bigint"))
    return fx.table(spark, sf_dir, "pages").select("page_id", found.alias("f")).select("page_id", "f.*")


WORDS = ["always", "ALL", " on-review ", "uncertain", "never", "0", "off", "bogus", "", "strict", "lenient", "block", "allow", "deny", "ok", "ignore", "fail_closed", "hard"]
WORD_SQL = f"{WORDS}[(event_id % {len(WORDS)} + 1)::INT]"


def _word(values: list[str]):
    return F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(values) + 1).cast("int"))


@query(f"""WITH w AS (SELECT event_id, lower(trim({WORD_SQL})) AS w FROM events) SELECT event_id,
CASE WHEN w IN ('on_review', 'on-review', 'onreview', 'only-review', 'only_review', 'when-review', 'when_review', 'review', 'uncertain') THEN 'on_review'
  WHEN w IN ('never', 'no-api', 'no_api', 'no-apis', 'no_apis', 'noapis', 'disable', 'off', 'disabled', 'false', '0', 'none') THEN 'never' ELSE 'always' END AS api,
CASE WHEN w IN ('ok', 'allow', 'open') THEN 'ok' WHEN w IN ('block', 'deny', 'fail', 'fail_closed') THEN 'block' ELSE 'review' END AS nothing,
CASE WHEN w IN ('block', 'not_ok', 'fail', 'fail_closed', 'deny') THEN 'block' WHEN w IN ('ignore', 'open', 'allow', 'lenient', 'loose') THEN 'ignore' ELSE 'review' END AS errors FROM w""")
def policy_alias_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _word(WORDS)
    return fx.table(spark, sf_dir, "events").select("event_id", c.api_policy(w).alias("api"), c.no_checks_policy(w).alias("nothing"), c.error_policy(w).alias("errors"))


INTS = ["5", "+5", "-3", "5.0", "5.00", "5.5", "", "  7 ", "abc", "1e3", "0", "007"]


@query(f"WITH v AS (SELECT event_id, trim({INTS}[(event_id % {len(INTS)} + 1)::INT]) AS v FROM events) SELECT event_id, CASE WHEN regexp_full_match(v, '[+-]?[0-9]+(\\.0+)?') THEN v::DOUBLE::BIGINT ELSE 42 END AS value FROM v")
def env_int_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").select("event_id", c.knob_int(_word(INTS), 42).alias("value"))


BOOLS = ["1", "TRUE", " yes", "On", "0", "false", "NO", "off", "", "maybe"]


@query(f"WITH v AS (SELECT event_id, lower(trim({BOOLS}[(event_id % 10 + 1)::INT])) AS v FROM events) SELECT event_id, CASE WHEN v IN ('1', 'true', 'yes', 'on') THEN true WHEN v IN ('0', 'false', 'no', 'off') THEN false ELSE true END AS value FROM v")
def env_bool_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").select("event_id", c.knob_bool(_word(BOOLS), True).alias("value"))


FLOATS = ["0.5", "nan", "inf", "-inf", "-1", "2", "x", "", " 0.25 "]


@query(f"WITH v AS (SELECT event_id, try_cast(trim({FLOATS}[(event_id % 9 + 1)::INT]) AS DOUBLE) AS v FROM events) SELECT event_id, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0.75 ELSE v END AS value, least(1.0, greatest(0.0, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0.125 ELSE v END))::DOUBLE AS unit FROM v")
def env_float_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _word(FLOATS)
    return fx.table(spark, sf_dir, "events").select("event_id", c.knob_float(w, 0.75).alias("value"), c.clamp01(w, 0.125).alias("unit"))


@query(f"WITH v AS (SELECT event_id, try_cast(trim({FLOATS}[(event_id % 9 + 1)::INT]) AS DOUBLE) AS v FROM events), f AS (SELECT event_id, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0.75 ELSE v END AS v FROM v) SELECT event_id, greatest(0.3, v)::DOUBLE AS low, least(0.6, v)::DOUBLE AS high, least(0.6, greatest(0.3, v))::DOUBLE AS both FROM f")
def env_float_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _word(FLOATS)
    return fx.table(spark, sf_dir, "events").select("event_id", c.knob_float(w, 0.75, low=0.3).alias("low"), c.knob_float(w, 0.75, high=0.6).alias("high"), c.knob_float(w, 0.75, 0.3, 0.6).alias("both"))


@query(f"WITH v AS (SELECT event_id, trim(CASE WHEN event_id % 5 > 0 THEN {INTS}[(event_id % {len(INTS)} + 1)::INT] WHEN event_id % 2 = 0 THEN {INTS}[((event_id + 7) % {len(INTS)} + 1)::INT] END) AS v FROM events) SELECT event_id, CASE WHEN regexp_full_match(v, '[+-]?[0-9]+(\\.0+)?') THEN v::DOUBLE::BIGINT ELSE 42 END AS value FROM v")
def env_int_first_defined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first knob that is defined decides, even if it is no number."""
    i = F.col("event_id")
    at = lambda shift: F.element_at(F.array(*map(F.lit, INTS)), ((i + shift) % len(INTS) + 1).cast("int"))
    return fx.table(spark, sf_dir, "events").select("event_id", c.knob_int_any([F.when(i % 5 > 0, at(0)), F.when(i % 2 == 0, at(7))], 42).alias("value"))


@query("SELECT event_id, least(1.0, greatest(0.0, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE value / 64.0 - 0.5 END))::DOUBLE AS score, CASE WHEN value < 0 THEN 0 ELSE trunc(value)::BIGINT END AS ms FROM events")
def clamp01(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 64.0 - 0.5)
    return fx.table(spark, sf_dir, "events").select("event_id", c.clamp01(raw).alias("score"), c.safe_ms(F.col("value")).alias("ms"))


LISTS = ["a, B ,a,,c", "['nudity-2.1', 'weapon']", '["x","y","x"]', "", "[one]"]


def _pick_sql(values: list[str]) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{quoted}][(event_id % {len(values)} + 1)::INT]"


DISTINCT_SQL = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
MODELS_SQL = """list_filter(list_transform(string_split(regexp_replace(trim(w), '^\\[(.*)\\]$', '\\1'), ','), lambda x: regexp_replace(trim(x), '^[\\s"''\\[]+|[\\s"''\\]]+$', '', 'g')), lambda x: x <> '')"""


@query(f"""WITH v AS (SELECT event_id, {_pick_sql(LISTS)} AS w FROM events),
m AS (SELECT event_id, list_distinct(list_filter(list_transform(string_split(w, ','), lambda x: lower(trim(x))), lambda x: x <> '')) AS s, {MODELS_SQL} AS l FROM v)
SELECT event_id, coalesce(array_to_string(list_sort(s), ','), '') AS labels, coalesce(array_to_string({DISTINCT_SQL.format('l')}, ','), '') AS models FROM m""")
def list_knobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _word(LISTS)
    return fx.table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(c.label_set(w)), ",").alias("labels"), c.model_list(w).alias("models"))


CORES = ["", "ocr, OpenAI", "phash_block,custom", "OCR,ocr , forbidden_symbols,yolo_forbidden_symbols", " , "]
ALIAS_SQL = """CASE WHEN lower(x) IN ('phash_allowlist', 'phash_allow') THEN 'pHash allowlist' WHEN lower(x) IN ('phash_blocklist', 'phash_block') THEN 'pHash blocklist' WHEN lower(x) = 'ocr' THEN 'OCR text'
 WHEN lower(x) = 'openai' THEN 'OpenAI Moderation' WHEN lower(x) = 'sightengine' THEN 'Sightengine' WHEN lower(x) IN ('forbidden_symbols_yolo', 'forbidden_symbols', 'yolo_forbidden_symbols') THEN 'YOLO forbidden symbols' ELSE x END"""


@query(f"""WITH v AS (SELECT event_id, list_filter(list_transform(string_split({_pick_sql(CORES)}, ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM events),
n AS (SELECT event_id, list_transform(l, lambda x: {ALIAS_SQL}) AS l FROM v)
SELECT event_id, CASE WHEN len(l) = 0 THEN 'pHash allowlist,pHash blocklist,OCR text,OpenAI Moderation,Sightengine,YOLO forbidden symbols' ELSE array_to_string({DISTINCT_SQL.format('l')}, ',') END AS core FROM n""")
def core_engine_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").select("event_id", F.array_join(c.core_engines(_word(CORES)), ",").alias("core"))


MESSAGES = ["Error code: 429 - slow down", "Too Many Requests", "Error code: 401", "Invalid API key given", "rate limit 429", "boom", "Error code: 500"]
MESSAGE_SQL = f"{MESSAGES}[(event_id % 7 + 1)::INT]"


@query(f"""WITH m AS (SELECT event_id, {MESSAGE_SQL} AS m, event_id % 4 AS a FROM events) SELECT event_id, nullif(regexp_extract(m, 'Error code:\\s*(\\d{{3}})', 1), '')::INT AS code,
contains(m, 'Error code: 429') OR contains(m, 'Too Many Requests') OR (contains(lower(m), 'rate') AND contains(m, '429')) AS rate_limited,
coalesce(nullif(regexp_extract(m, 'Error code:\\s*(\\d{{3}})', 1), '')::INT IN (401, 403), false) OR contains(lower(m), 'invalid api key') AS auth, least(10.0, pow(2.0, a))::DOUBLE AS wait FROM m""")
def api_error_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events").select("event_id", _word(MESSAGES).alias("m"))
    found = e.select("event_id", c.error_class(F.col("m"), F.lit(None).cast("int")).alias("f"), c.backoff(F.col("event_id") % 4).alias("wait"))
    return found.select("event_id", "f.*", "wait")


# ---- detections and scores --------------------------------------------------------------------------------------

NAMES = ["FEMALE_BREAST_EXPOSED", "Toy gun", "Rifle", "Kitchen knife", "BELLY_COVERED", "pistol", "Dagger", "cat", "FACE_FEMALE"]
NAME_SQL = f"{NAMES}[(event_id % 9 + 1)::INT]"
DET_SQL = f"d AS (SELECT user_id AS media_id, event_id AS seq, {NAME_SQL} AS label, least(1.0, greatest(0.0, (event_id % 101) / 128.0))::DOUBLE AS c FROM events)"


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("media_id"), F.col("event_id").alias("seq"), _word(NAMES).alias("label"), ((F.col("event_id") % 101) / 128.0).alias("confidence"))


@query(f"""WITH {DET_SQL}, g AS (SELECT media_id, coalesce(max(c) FILTER (label LIKE '%EXPOSED%'), 0) AS nudity_exposed, coalesce(max(c) FILTER (label LIKE '%COVERED%' AND label NOT LIKE '%EXPOSED%'), 0) AS nudity_covered,
coalesce(max(c) FILTER (lower(label) IN ('toy gun', 'rifle', 'pistol')), 0) AS yolo_firearm, coalesce(max(c) FILTER (label = 'Toy gun'), 0) AS yolo_firearm_toy, coalesce(max(c) FILTER (label IN ('Kitchen knife', 'Dagger')), 0) AS yolo_knife FROM d GROUP BY media_id)
SELECT media_id, nudity_exposed, nudity_covered, yolo_firearm AS yolo_firearm_realistic, yolo_firearm_toy, yolo_firearm, yolo_knife, yolo_knife AS yolo_knife_dangerous, greatest(yolo_firearm, yolo_firearm_toy) AS yolo_firearm_any FROM g""")
def detections_conditional_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _detections(spark, sf_dir)
    return detections.detection_scores(d, *detections.nudity_columns(), *detections.weapon_columns())


SYMBOL_SQL = f"WITH {DET_SQL} SELECT media_id, count(*) AS forbidden_symbols_detection_count, max(c) AS forbidden_symbols_max_conf, arg_max(label, struct_pack(c := c, s := -seq)) AS top_label, 1.0::DOUBLE AS forbidden_symbols_detected, CASE WHEN max(c) >= 0.3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS forbidden_symbols_review_hit, CASE WHEN max(c) >= 0.75 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS forbidden_symbols_block_hit FROM d {{w}} GROUP BY media_id"


@query(SYMBOL_SQL.format(w=""))
def detections_argmax_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.symbol_scores(_detections(spark, sf_dir), block=0.75)


@query(SYMBOL_SQL.format(w="WHERE lower(label) NOT IN ('cat', 'rifle')"))
def detections_ignore_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.symbol_scores(_detections(spark, sf_dir), ("cat", "rifle"), block=0.75)


@query("""WITH b AS (SELECT event_id, event_id % 300 - 20.0 AS x1, event_id % 170 - 10.0 AS y1, event_id % 300 + event_id % 64 * 1.0 AS x2, event_id % 170 + event_id % 32 * 1.0 AS y2, event_id % 13 = 0 AS short FROM events),
n AS (SELECT *, 256.0 AS w, 128.0 AS h FROM b), u AS (SELECT event_id, short, least(1, greatest(0, x1 / w)) AS nx1, least(1, greatest(0, y1 / h)) AS ny1, least(1, greatest(0, x2 / w)) AS nx2, least(1, greatest(0, y2 / h)) AS ny2, least(1, greatest(0, greatest(0, x2 - x1) * greatest(0, y2 - y1) / (w * h))) AS a FROM n)
SELECT event_id, (CASE WHEN short THEN 0 ELSE nx1 END)::DOUBLE AS nx1, (CASE WHEN short THEN 0 ELSE ny1 END)::DOUBLE AS ny1, (CASE WHEN short THEN 0 ELSE nx2 END)::DOUBLE AS nx2, (CASE WHEN short THEN 0 ELSE ny2 END)::DOUBLE AS ny2, (CASE WHEN short THEN 0 ELSE a END)::DOUBLE AS area_ratio FROM u""")
def detections_bbox_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    x1, y1 = i % 300 - F.lit(20.0), i % 170 - F.lit(10.0)
    corners = F.array(x1, y1, i % 300 + i % 64 * F.lit(1.0), i % 170 + i % 32 * F.lit(1.0))
    box = F.when(i % 13 == 0, F.array(x1, y1)).otherwise(corners)
    s = c.box_shape(box, F.lit(256), F.lit(128))
    named = fx.table(spark, sf_dir, "events").select("event_id", s.alias("s"))
    return named.select("event_id", *[F.col("s.norm")[k].alias(n) for k, n in enumerate(("nx1", "ny1", "nx2", "ny2"))], F.col("s.area_ratio").alias("area_ratio"))


@query("SELECT event_id, coalesce(CASE event_id % 5 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' END, CASE event_id % 5 WHEN 2 THEN 'two' END, (event_id % 5)::VARCHAR) AS name FROM events")
def detections_class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, model = F.create_map(F.lit(0), F.lit("zero"), F.lit(1), F.lit("one")), F.create_map(F.lit(0), F.lit("other"), F.lit(2), F.lit("two"))
    return fx.table(spark, sf_dir, "events").select("event_id", c.class_name((F.col("event_id") % 5).cast("int"), own, model).alias("name"))


@query("SELECT user_id AS media_id, event_type AS key, greatest(0, max(value / 400))::DOUBLE AS value FROM events GROUP BY ALL")
def scores_max_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("media_id"), F.create_map("event_type", F.col("value") / 400).alias("scores"))
    return scores.merge_scores(e, "media_id", "scores").select("media_id", F.explode("scores").alias("key", "value"))


@query("WITH p AS (SELECT user_id AS media_id, event_id AS pos, 'k' || event_id AS key, (event_id % 16) / 16.0 AS v FROM events) SELECT media_id, string_agg(key, ',' ORDER BY v DESC, pos) AS shown FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY v DESC, pos) <= 8) GROUP BY media_id")
def scores_topk_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    row = F.struct(F.col("event_id").alias("at"), F.concat(F.lit("k"), "event_id").alias("key"), ((F.col("event_id") % 16) / 16.0).alias("value"))
    entries = e.groupBy(F.col("user_id").alias("media_id")).agg(F.sort_array(F.collect_list(row)).alias("e"))
    plain = F.transform("e", lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))
    return entries.select("media_id", F.array_join(F.transform(scores.shown_scores("other", plain), lambda x: x["key"]), ",").alias("shown"))


REST = ("weapon_firearm_gesture", "weapon_firearm_type_animated", "violence_physical_violence", "violence_firearm_threat", "gore_very_bloody", "gore_corpse")
SHOWN_MODES_SQL = f"""WITH s AS (SELECT doc_id AS media_id, doc_id AS m FROM documents),
r AS (SELECT media_id, list_filter(list_sort([{', '.join(f"struct_pack(down := -({fx.score_sql(n)}), o := {o}, k := '{n}')" for o, n in enumerate(fx.ENGINES["Sightengine"]) if n in REST)}])[1:2], lambda e: -e.down >= 0.05) AS rest FROM s)
SELECT media_id, 'nudity_safe,nudity_raw,nudity_partial,weapon_firearm,weapon_firearm_toy,weapon_knife,gore_prob,violence_prob,offensive_max' || CASE WHEN len(rest) > 0 THEN ',' || array_to_string(list_transform(rest, lambda e: e.k), ',') ELSE '' END AS compact,
  '{','.join(fx.ENGINES["Sightengine"])}' AS everything, 'weapon_knife,nudity_raw' AS chosen FROM r"""


@query(SHOWN_MODES_SQL)
def scores_shown_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report shows of nested API scores: the usual ones and the two highest others, all, or those asked for."""
    d = fx.table(spark, sf_dir, "documents")
    entries = F.array(*[F.struct(F.lit(n).alias("key"), fx.score(n, F.col("doc_id")).alias("value")) for n in fx.ENGINES["Sightengine"]])
    rows = d.select(F.col("doc_id").alias("media_id"), F.explode(F.array(entries)).alias("e"))
    shown = lambda **how: F.array_join(F.transform(scores.shown_scores("Sightengine", F.col("e"), **how), lambda x: x["key"]), ",")
    return rows.select("media_id", shown(extra=2).alias("compact"), shown(mode="full").alias("everything"), shown(mode="keys", keys=("weapon_knife", "nope", "nudity_raw")).alias("chosen"))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested responses with binary fractions, built from the events."""
    i = F.col("event_id")
    s = lambda j: ((i * (2 * j + 1) + j) % 65 / F.lit(64.0))
    nudity = F.struct(s(0).alias("sexual_activity"), s(1).alias("erotica"), s(2).alias("suggestive"), s(3).alias("none"), F.struct(s(4).alias("neutral"), F.struct(s(5).alias("bikini"), F.array(F.struct(s(6).alias("deep"))).alias("more")).alias("nested")).alias("suggestive_classes"))
    weapon = F.struct(F.struct(s(7).alias("firearm"), s(8).alias("knife")).alias("classes"), F.when(i % 3 == 0, s(9)).alias("firearm_toy"), F.struct(s(10).alias("animated")).alias("firearm_type"))
    body = F.to_json(F.struct(F.lit("success").alias("status"), F.lit(5).alias("operations"), nudity.alias("nudity"), weapon.alias("weapon"), s(11).alias("gore"), F.struct(s(12).alias("prob"), F.struct(s(13).alias("nazi"), s(15).alias("supremacist")).alias("classes"), s(14).alias("supremacist")).alias("offensive")))
    return fx.table(spark, sf_dir, "events").select("event_id", body.alias("body"))


def _s(j: int) -> str:
    return f"((event_id * {2 * j + 1} + {j}) % 65 / 64.0)::DOUBLE"


@query(f"""WITH p AS (SELECT event_id, {_s(3)} AS safe, greatest({_s(0)}, {_s(1)}) AS raw, greatest({_s(2)}, {_s(5)}, {_s(6)}) AS part FROM events)
SELECT event_id, safe AS nudity_safe, raw AS nudity_raw, CASE WHEN safe > 0 THEN least(part, greatest(0, 1 - safe)) ELSE part END AS nudity_partial FROM p""")
def scores_nudity_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = scores.flattened(_responses(spark, sf_dir), "body", "s").select("event_id", "s")
    return flat.select("event_id", *[F.col("s")[k].alias(k) for k in ("nudity_safe", "nudity_raw", "nudity_partial")])


@query(f"WITH p AS (SELECT event_id, {_s(7)} AS f, {_s(8)} AS k, CASE WHEN event_id % 3 = 0 THEN {_s(9)} END AS t, {_s(10)} AS a FROM events) SELECT event_id, f AS weapon_firearm, k AS weapon_knife, t AS weapon_firearm_toy, a AS weapon_firearm_type_animated, f * (1 - greatest(coalesce(t, 0), a)) AS realistic FROM p")
def scores_weapon_realistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = scores.flattened(_responses(spark, sf_dir), "body", "s").select("event_id", "s")
    keys = ("weapon_firearm", "weapon_knife", "weapon_firearm_toy", "weapon_firearm_type_animated")
    out = flat.select("event_id", *[F.try_element_at("s", F.lit(k)).alias(k) for k in keys])
    return out.withColumn("realistic", F.col("weapon_firearm") * (1 - F.greatest(F.coalesce("weapon_firearm_toy", F.lit(0.0)), "weapon_firearm_type_animated")))


@query(f"SELECT event_id, {_s(11)} AS gore_prob, {_s(12)} AS offensive_prob, {_s(13)} AS offensive_nazi, greatest({_s(12)}, {_s(13)}, {_s(14)}, {_s(15)}) AS offensive_max, 5.0::DOUBLE AS operations_used FROM events")
def scores_offensive_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = scores.flattened(_responses(spark, sf_dir), "body", "s").select("event_id", "s")
    return flat.select("event_id", *[F.col("s")[k].alias(k) for k in ("gore_prob", "offensive_prob", "offensive_nazi", "offensive_max", "operations_used")])


@query(f"SELECT event_id, {_s(1)} AS sexual, {_s(2)} AS hate, greatest({_s(1)}, {_s(2)}) AS max_any_category, CASE WHEN event_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flagged FROM events")
def scores_moderation_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    s = lambda j: ((i * (2 * j + 1) + j) % 65 / F.lit(64.0))
    body = F.to_json(F.struct(F.array(F.struct((i % 2 == 0).alias("flagged"), F.struct(s(1).alias("sexual"), s(2).alias("hate")).alias("category_scores"))).alias("results")))
    m = scores.category_scores(body)
    return fx.table(spark, sf_dir, "events").select("event_id", m.alias("m")).select("event_id", *[F.col("m")[k].alias(k) for k in ("sexual", "hate", "max_any_category", "flagged")])


# ---- cache ------------------------------------------------------------------------------------------------------


@query("WITH k AS (SELECT event_type || '-' || user_id AS key, min(event_id) AS seq, max_by(props, event_id) AS value FROM events GROUP BY 1) SELECT key, seq, value FROM k ORDER BY seq DESC LIMIT 50")
def cache_stream_evict_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream into a cache of 50 entries, kept as the stream's state."""
    schema = fx.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a stream takes a pattern or a folder, not a file
    updates = events.select(F.concat("event_type", F.lit("-"), "user_id").alias("key"), F.col("event_id").alias("seq"), F.col("props").alias("value"))
    path = scratch(spark, "cache-stream")
    cache_state.start(cache_state.cache_changes(updates, 50), f"{path}/changes", f"{path}/checkpoint").awaitTermination()
    return cache_state.cache_of(spark.read.parquet(f"{path}/changes"))


@query("WITH b AS (SELECT md5(text) AS key, min(item_id) AS label FROM benchmark GROUP BY 1), d AS (SELECT md5(text) AS key, min(doc_id) AS label FROM documents GROUP BY 1) SELECT key, coalesce(b.label, d.label) AS label, b.label IS NOT NULL AS earlier FROM d FULL JOIN b USING (key)")
def cache_store_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two jobs insert entries into a store; a key of both keeps the entry of the first."""
    path = scratch(spark, "entries")
    for name, row in (("benchmark", "item_id"), ("documents", "doc_id")):
        rows = fx.table(spark, sf_dir, name).groupBy(F.md5("text").alias("key")).agg(F.min(row).alias("label"))
        store.add_entries(rows.withColumn("earlier", F.lit(name == "benchmark")), path, 10_000)
    return store.first_entries(store.read_entries(spark, path, "key string, label bigint, earlier boolean"), ["key"]).drop("seq")


@query("SELECT doc_id, sha256('model-x' || chr(10) || lang || chr(10) || text) AS key FROM documents")
def api_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents")
    return d.select("doc_id", cache.cache_key(F.lit("model-x"), F.col("lang"), F.array(F.encode("text", "utf-8"))).alias("key"))


@query("WITH c AS (SELECT md5(text) AS key, max(item_id) AS item FROM benchmark GROUP BY 1 UNION SELECT md5(text), doc_id FROM (SELECT text, min(doc_id) AS doc_id FROM documents WHERE lang = 'de' GROUP BY text)) SELECT doc_id, key IS NOT NULL AS hit FROM documents LEFT JOIN (SELECT DISTINCT key FROM c) k ON md5(text) = key")
def api_cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents")
    have = fx.table(spark, sf_dir, "benchmark").select(F.md5("text").alias("key")).unionByName(d.filter("lang = 'de'").select(F.md5("text").alias("key"))).distinct()
    hits, misses = cache.look_up(d.select("doc_id", F.md5("text").alias("key")), have)
    return hits.select("doc_id", F.lit(True).alias("hit")).unionByName(misses.select("doc_id", F.lit(False).alias("hit")))


@query("WITH b AS (SELECT md5(text) AS key, 0 AS n, doc_id AS seq, lang AS v FROM documents UNION ALL SELECT md5(text), 1, 10000000 + item_id, 'bench' FROM benchmark), m AS (SELECT key, min(seq) AS seq, arg_max(v, struct_pack(n := n, s := seq)) AS v FROM b GROUP BY key) SELECT key, seq, v FROM m ORDER BY seq DESC, key DESC LIMIT 200")
def api_cache_evict_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = fx.table(spark, sf_dir, "documents").select(F.md5("text").alias("key"), F.col("doc_id").alias("seq"), F.col("lang").alias("v"))
    new = fx.table(spark, sf_dir, "benchmark").select(F.md5("text").alias("key"), (F.col("item_id") + 10_000_000).alias("seq"), F.lit("bench").alias("v"))
    return cache.insert_and_evict(old, new, 200)


# ---- verdicts ---------------------------------------------------------------------------------------------------


def _told(verdicts: DataFrame) -> DataFrame:
    codes = F.array_join(F.transform("reasons", lambda r: r["code"]), ",")
    return verdicts.select("media_id", "label", "nudity_risk", "violence_risk", "hate_risk", codes.alias("reason_codes"))


def _verdict_query(name: str, engines: tuple[str, ...] | None, errors: bool = True, error_policy: str = "review", no_checks: str = "review", switched: bool = False) -> None:
    switches = dict.fromkeys(("allow_toy", "block_all_knives", "se_block_any_firearm", "se_block_all_knives"), switched)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _told(fold(fx.results(spark, sf_dir, engines, errors), Settings(error_policy=error_policy, no_checks_policy=no_checks, **switches)))

    run.__name__ = name
    query(fx.verdict_sql(engines, errors, error_policy, no_checks.upper(), switched))(run)


_verdict_query("verdict_nsfw", ("NudeNet", "OpenNSFW2"), errors=False)
_verdict_query("verdict_symbols", ("YOLO forbidden symbols",), errors=False)
_verdict_query("verdict_weapons", ("YOLO-World weapons",), errors=False)
_verdict_query("verdict_sightengine", ("Sightengine",), errors=False)
_verdict_query("verdict_weapons_switched", ("YOLO-World weapons",), errors=False, switched=True)
_verdict_query("verdict_sightengine_switched", ("Sightengine",), errors=False, switched=True)
_verdict_query("verdict_openai", ("OpenAI Moderation",), errors=False)
_verdict_query("verdict_terminal_order", ("pHash blocklist", "pHash allowlist", "OCR text", "OpenNSFW2"), errors=False)
_verdict_query("verdict_error_policy", None, error_policy="block")
_verdict_query("verdict_error_ignore", None, error_policy="ignore")
_verdict_query("verdict_no_checks", ("OCR text", "NudeNet"), no_checks="block")
_verdict_query("verdict_full", None)


@query("WITH " + fx.RUNS_SQL + ", n AS (SELECT coalesce(nullif(label, ''), 'UNKNOWN') AS label, 1 AS one FROM it UNION ALL SELECT unnest(['OK', 'REVIEW', 'BLOCK']), 0) SELECT label, sum(one)::BIGINT AS items FROM n GROUP BY label")
def verdict_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.verdict_counts(fx.items(spark, sf_dir))


# ---- stages -----------------------------------------------------------------------------------------------------

LOCAL = tuple(e for e in fx.ENGINES if e not in ("OpenAI Moderation", "Sightengine"))
STAGED_SQL = f"WITH l AS ({fx.verdict_sql(LOCAL)}), f AS ({fx.verdict_sql()}) SELECT l.media_id, CASE WHEN l.label = 'REVIEW' THEN f.label ELSE l.label END AS label, l.label = 'REVIEW' AS asked FROM l JOIN f USING (media_id)"


@query(STAGED_SQL)
def stage_api_on_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = fx.results(spark, sf_dir)
    local = F.col("engine").isin(*LOCAL)
    media = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"), F.lit(None).cast("string").alias("load_error"))
    nothing = results.limit(0)
    pick = lambda chosen: lambda m: results.filter(chosen).join(m.select("media_id"), "media_id", "left_semi")
    route = routing.Route(short_circuit=False, api_policy="on_review")
    done = routing.moderate(media, lambda m: nothing, pick(local), pick(~local), route=route, keep=lambda df, _: df)
    asked = fold(results.filter(local)).select("media_id", (F.col("label") == "REVIEW").alias("asked"))
    return done.select("media_id", "label").join(asked, "media_id")


@query(f"WITH l AS ({fx.verdict_sql(LOCAL)}), s AS (SELECT doc_id AS m, CASE WHEN (doc_id * 3) % 7 < 2 AND {fx.score_sql('phash_block_match').replace('m *', 'doc_id *')} = 1 THEN 'BLOCK' WHEN (doc_id * 3 + 5) % 7 < 2 AND {fx.score_sql('phash_allow_match').replace('m *', 'doc_id *')} = 1 THEN 'OK' END AS early FROM documents) SELECT media_id, coalesce(early, label) AS label, early IS NOT NULL AS settled FROM l JOIN s ON m = media_id")
def stage_short_circuit_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = fx.results(spark, sf_dir)
    pre = results.filter(F.col("engine").startswith("pHash"))
    early = routing.settled_by_hash(pre)
    rest = results.filter(F.col("engine").isin(*LOCAL)).join(early.select("media_id"), "media_id", "left_anti")
    return early.select("media_id", "label", F.lit(True).alias("settled")).unionByName(fold(rest).select("media_id", "label", F.lit(False).alias("settled")))


@query(f"WITH l AS ({fx.verdict_sql(('OpenNSFW2',), False)}) SELECT media_id, CASE WHEN media_id % 10 = 3 THEN 'REVIEW' ELSE label END AS label, CASE WHEN media_id % 10 = 3 THEN 0.0 ELSE nudity_risk END AS nudity_risk, CASE WHEN media_id % 10 = 3 THEN 'loader_failure' ELSE reason_codes END AS reason_codes FROM l")
def stage_loader_failure_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = fx.results(spark, sf_dir, ("OpenNSFW2",), False)
    broken = F.when(F.col("doc_id") % 10 == 3, "UnidentifiedImageError: bad header")
    media = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"), broken.alias("load_error"))
    nothing = results.limit(0)
    local = lambda m: results.join(m.select("media_id"), "media_id", "left_semi")
    done = routing.moderate(media, lambda m: nothing, local, lambda m: nothing, route=routing.Route(False, "never"), keep=lambda df, _: df)
    return _told(done).drop("violence_risk", "hate_risk")


@query(f"WITH {fx.HASHES_SQL}, v AS ({fx.verdict_sql(('OpenNSFW2',), False)}) SELECT DISTINCT CASE label WHEN 'OK' THEN 'allow' ELSE 'block' END AS list_kind, printf('%016x', u.v::UBIGINT) AS hex, CASE label WHEN 'OK' THEN 'ok' ELSE 'not_ok' END AS label FROM v JOIN (SELECT media_id AS vec, v FROM u) u ON media_id = vec WHERE label <> 'REVIEW'")
def autolearn_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = fold(fx.results(spark, sf_dir, ("OpenNSFW2",), False))
    hexes = fx.hashes(spark, sf_dir).select("media_id", c.hex_of_bits(F.col("bits")).alias("first_hex"), c.hex_of_bits(F.col("bits")).alias("last_hex"))
    return routing.learned(verdicts, hexes, routing.Learning(enabled=True, first_and_last=True))


#: The plain loop: each input is judged by the lists so far, which carry on to the next.
IN_ORDER_SQL = f"""
WITH RECURSIVE {fx.HASHES_SQL}, {fx.TURNS_SQL},
run(k, turn, label, settled_by, distance, learned, block, allow) AS (
  SELECT 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::INT, NULL::BOOLEAN, block, allow FROM given
  UNION ALL
  SELECT k, turn, label, settled_by, CASE settled_by WHEN 'block' THEN b WHEN 'allow' THEN a END, CASE settled_by WHEN 'block' THEN coalesce(gb > b, true) WHEN 'allow' THEN coalesce(ga > a, true) END,
         CASE WHEN label = 'BLOCK' THEN block || [f, l] ELSE block END, CASE WHEN label = 'OK' THEN allow || [f, l] ELSE allow END
  FROM (SELECT *, CASE WHEN b <= 1 THEN 'BLOCK' WHEN a <= 0 THEN 'OK' ELSE own END AS label, CASE WHEN b <= 1 THEN 'block' WHEN a <= 0 THEN 'allow' END AS settled_by
    FROM (SELECT t.*, run.block, run.allow,
      list_min(list_transform(run.block, lambda e: least(bit_count(xor(e, f)), bit_count(xor(e, l)))))::INT AS b, list_min(list_transform(run.allow, lambda e: least(bit_count(xor(e, f)), bit_count(xor(e, l)))))::INT AS a,
      list_min(list_transform(given.block, lambda e: least(bit_count(xor(e, f)), bit_count(xor(e, l)))))::INT AS gb, list_min(list_transform(given.allow, lambda e: least(bit_count(xor(e, f)), bit_count(xor(e, l)))))::INT AS ga
      FROM run JOIN t ON t.k = run.k + 1, given)))
SELECT turn, label, settled_by, distance, learned FROM run WHERE k > 0
"""


@query(IN_ORDER_SQL)
def autolearn_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of inputs that learn from each other, one after the other."""
    h = fx.hashes(spark, sf_dir)
    how = routing.Learning(enabled=True, first_and_last=True)
    return learning.learn_in_order(fx.turns(h), fx.given_entries(h), how, block_radius=1, allow_radius=0)


@query("""WITH g AS (SELECT user_id AS media_id, count(*) FILTER (event_type IS NULL OR event_id % 50 = 7) AS bad, arg_max(event_type, struct_pack(v := value, o := -event_id)) AS label, max(value) AS peak, count(*) AS n FROM events GROUP BY 1)
SELECT media_id, CASE WHEN bad > 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN bad = 0 THEN peak END AS peak, CASE WHEN bad = 0 THEN n::DOUBLE END AS rows, CASE WHEN bad = 0 THEN label END AS label FROM g""")
def engine_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An engine called from SQL on the events of each user; users with a row that has no label are errors."""
    register_engines(spark)
    events = fx.table(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").alias("media_id"), F.col("event_id").alias("idx"), F.when(F.col("event_id") % 50 != 7, F.col("event_type")).alias("label"), F.col("value").alias("confidence"))
    found = spark.sql("SELECT media_id, status, scores, details FROM engine_results(TABLE({rows}) PARTITION BY media_id ORDER BY idx, engine => 'mediasift.operators.table_functions:PeakScore')", rows=rows)
    score = lambda k: F.try_element_at("scores", F.lit(k)).alias(k)
    return found.select("media_id", "status", score("peak"), score("rows"), F.try_element_at("details", F.lit("label")).alias("label"))


SYMBOLS_SQL = """WITH d AS (SELECT user_id AS m, event_id AS seq, event_type AS label, (event_id % 97) / 96.0::DOUBLE AS c, event_id % 5 AS pos FROM events),
k AS (SELECT m, count(*) AS n, max(c) AS top, arg_max(label, struct_pack(c := c, s := -seq)) AS label FROM d WHERE pos < 2 AND label <> 'click' GROUP BY m)
SELECT i.m AS media_id, w AS most_frames, CASE WHEN w > 0 AND n > 0 THEN n::DOUBLE ELSE 0.0::DOUBLE END AS found, CASE WHEN w > 0 AND n > 0 THEN top ELSE 0.0::DOUBLE END AS top_conf,
  CASE WHEN w > 0 AND top >= 0.9 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS block_hit, CASE WHEN w > 0 THEN coalesce(label, '') ELSE '' END AS top_label, w <= 0 AS skipped
FROM (SELECT DISTINCT m FROM d) i CROSS JOIN (VALUES (0), (2)) v(w) LEFT JOIN k ON k.m = i.m"""


@query(SYMBOLS_SQL)
def symbols_of_first_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols in the first two frames of each item, and with frames switched off."""
    e = fx.table(spark, sf_dir, "events")
    seen = e.select(F.col("user_id").alias("media_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("label"), ((F.col("event_id") % 97) / F.lit(96.0)).alias("confidence"), (F.col("event_id") % 5).alias("frame_pos"))
    media = seen.select("media_id").distinct()
    parts = [detections.symbol_results(media, seen, most, ("click",)).withColumn("most_frames", F.lit(most)) for most in (0, 2)]
    score = lambda n: F.col("scores")[f"forbidden_symbols_{n}"]
    both = parts[0].unionByName(parts[1])
    return both.select("media_id", "most_frames", score("detection_count").alias("found"), score("top_conf").alias("top_conf"), score("block_hit").alias("block_hit"), F.col("details")["top_label"].alias("top_label"), F.coalesce(F.try_element_at("details", F.lit("inference_skipped")) == "true", F.lit(False)).alias("skipped"))


# ---- runtime statistics -----------------------------------------------------------------------------------------

STATS_SQL = "round(sum({t}) / count(*), 2) AS avg_{p}ms, trunc(quantile_cont({t}, 0.5))::BIGINT AS median_{p}ms, min({t}) AS min_{p}ms, max({t}) AS max_{p}ms, quantile_disc({t}, 0.95) AS p95_{p}ms"
CLEAN_ITEMS = "CASE WHEN total_ms < 0 THEN 0 ELSE total_ms END"


@query(f"WITH {fx.RUNS_SQL}, e AS (SELECT media_id, sum(ms)::BIGINT AS engine_total_ms, count(*) AS engine_count, arg_max(engine, struct_pack(t := ms, o := -engine_ord)) AS slowest_engine, max(ms) AS slowest_engine_ms FROM r GROUP BY media_id), i AS (SELECT media_id, {CLEAN_ITEMS} AS total_ms FROM it) SELECT media_id, total_ms, engine_total_ms, engine_count, slowest_engine, slowest_engine_ms, greatest(0, total_ms - engine_total_ms) AS unattributed_ms FROM i JOIN e USING (media_id)")
def bench_item_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.item_rollup(fx.runs(spark, sf_dir), fx.items(spark, sf_dir))


@query(f"WITH {fx.RUNS_SQL} SELECT media_id, to_json(list(struct_pack(name := engine, status := lower(status), took_ms := ms) ORDER BY engine_ord))::VARCHAR AS engines FROM r GROUP BY media_id")
def bench_item_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of an item, in order."""
    return runtime.item_engines(fx.runs(spark, sf_dir)).select("media_id", F.to_json("engines").alias("engines"))


@query(f"WITH {fx.RUNS_SQL}, i AS (SELECT {CLEAN_ITEMS} AS t FROM it) SELECT count(*) AS total_files, sum(t)::BIGINT AS total_ms, sum(t)::BIGINT AS total_wall_ms, {STATS_SQL.format(t='t', p='file_')} FROM i")
def bench_file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.file_summary(fx.items(spark, sf_dir))


ROLLUP_SQL = f"WITH {fx.RUNS_SQL}, s AS (SELECT *, lower(status) AS s FROM r) SELECT engine, count(*) AS runs, count(*) FILTER (s = 'ok') AS ok, count(*) FILTER (s IN ('skipped', 'skip', 'disabled')) AS skipped, count(*) FILTER (s = 'error') AS error, count(*) FILTER (s NOT IN ('ok', 'error', 'skipped', 'skip', 'disabled')) AS other_status, sum(ms)::BIGINT AS total_ms, {STATS_SQL.format(t='ms', p='')} FROM s GROUP BY engine"


@query(ROLLUP_SQL)
def bench_engine_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.engine_rollup(fx.runs(spark, sf_dir))


@query(f"WITH b AS ({ROLLUP_SQL}) SELECT engine, row_number() OVER (ORDER BY total_ms DESC, avg_ms DESC, engine)::INT AS place FROM b")
def bench_engine_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = runtime.engine_ranking(runtime.engine_rollup(fx.runs(spark, sf_dir)))  # a row an engine
    return ranked.agg(F.collect_list(F.struct("total_ms", "avg_ms", "engine")).alias("a")).select(F.posexplode(F.array_sort("a", lambda x, y: F.when(x["total_ms"] > y["total_ms"], -1).when(x["total_ms"] < y["total_ms"], 1).when(x["avg_ms"] > y["avg_ms"], -1).when(x["avg_ms"] < y["avg_ms"], 1).when(x["engine"] < y["engine"], -1).otherwise(1)))).select(F.col("col.engine").alias("engine"), (F.col("pos") + 1).alias("place"))


@query(f"WITH {fx.RUNS_SQL} SELECT engine, lower(status) AS status, count(*) AS runs FROM r GROUP BY 1, 2")
def bench_status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.runs(spark, sf_dir).groupBy("engine", c.status(F.col("status")).alias("status")).agg(F.count("*").alias("runs"))


@query(f"WITH {fx.RUNS_SQL} SELECT engine, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, max(ms) AS p100 FROM r GROUP BY engine")
def bench_p95_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = fx.runs(spark, sf_dir).select("engine", c.safe_ms(F.col("took_ms")).alias("ms"))
    return clean.groupBy("engine").agg(runtime.nearest_rank("ms", 50).alias("p50"), runtime.nearest_rank("ms", 95).alias("p95"), runtime.nearest_rank("ms", 200).alias("p100"))


@query(f"WITH {fx.RUNS_SQL} SELECT media_id, total_ms, input_ord FROM it ORDER BY total_ms DESC, input_ord LIMIT 10")
def bench_slowest_files_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.slowest_files(fx.items(spark, sf_dir)).select("media_id", "total_ms", "input_ord")


@query("SELECT l_returnflag AS engine, count(*) AS runs, sum(trunc(l_quantity)::BIGINT)::BIGINT AS total_ms, quantile_disc(trunc(l_quantity)::BIGINT, 0.95) AS p95_ms FROM lineitem GROUP BY 1")
def bench_lineitem_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = fx.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("engine"), F.lit("ok").alias("status"), F.col("l_quantity").alias("took_ms"))
    return runtime.engine_rollup(li).select("engine", "runs", "total_ms", "p95_ms")


@query("WITH " + fx.RUNS_SQL + " SELECT CASE WHEN coalesce(bool_and(label = 'OK'), false) THEN 0 ELSE 2 END::INT AS exit_code FROM it")
def exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.exit_code(fx.items(spark, sf_dir))
