"""Images, animations, lists, settings, stages, streams and the command line."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediasift import cli, report
from mediasift.functions.columns import bits_of_hex
from mediasift.functions.imagehash import cosine_matrix, hash_of_image, hash_pixels, resize_matrix
from mediasift.operators import engines, matching, remote, routing, text
from mediasift.operators.engines import Engine, allowlist_engine, blocklist_engine, run_engines, table_engine, text_engine
from mediasift.operators.scores import shown_scores
from mediasift.sources import models, settings
from mediasift.sources.gif import gif_frames
from mediasift.sources.lists import append_hashes, read_cache, read_hash_list, read_hash_store
from mediasift.sources.media import animation_hashes, list_media, read_images, sample_places
from mediasift.streaming.landing import arriving_files, moderate_stream


def png(pixels: np.ndarray) -> bytes:
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def gif(frames: list[np.ndarray], colours: list[tuple[int, int, int]]) -> bytes:
    """Frames of indices below 4, written with a clear code before every pixel pair."""
    h, w = frames[0].shape
    out = b"GIF89a" + struct.pack("<HH", w, h) + b"\x81\0\0" + bytes(x for c in colours for x in c)
    for f in frames:
        codes = []
        for i, v in enumerate(f.reshape(-1)):
            codes += ([4] if i % 2 == 0 else []) + [int(v)]
        bits, n, packed = 0, 0, bytearray()
        for c in [*codes, 5]:
            bits |= c << n
            n += 3
            while n >= 8:
                packed.append(bits & 255)
                bits >>= 8
                n -= 8
        packed.append(bits & 255)
        blocks = b"".join(bytes([len(packed[i : i + 255])]) + packed[i : i + 255] for i in range(0, len(packed), 255))
        out += b"\x21\xf9\x04\0\0\0\0\0" + b"\x2c" + struct.pack("<HHHH", 0, 0, w, h) + b"\0" + b"\x02" + blocks + b"\0"
    return out + b";"


def picture(seed: int, size: int = 48) -> np.ndarray:
    y, x = np.mgrid[0:size, 0:size]
    g = np.random.default_rng(seed).random(3) * 6
    return np.stack([127 + 120 * np.sin(x / (4 + g[0]) + g[1]) * np.cos(y / (5 + g[2]))] * 3, 2).astype(np.uint8)


def test_cosine_matrix_is_orthonormal():
    assert np.allclose(cosine_matrix(32) @ cosine_matrix(32).T, np.eye(32), atol=1e-5)
    assert np.allclose(resize_matrix(100, 32).sum(axis=1), 1)


def test_hash_survives_scaling_and_tells_pictures_apart():
    a, b = (int(hash_pixels(picture(1, n)), 16) for n in (48, 48))
    assert a == b and (a ^ int(hash_pixels(picture(2)), 16)).bit_count() > 8
    big = np.repeat(np.repeat(picture(1), 2, 0), 2, 1)
    assert (a ^ int(hash_pixels(big), 16)).bit_count() <= 4


def test_gif_round_trip():
    frames = [np.random.default_rng(i).integers(0, 4, (6, 9)) for i in range(3)]
    colours = [(0, 0, 0), (255, 0, 0), (0, 255, 0), (9, 9, 200)]
    got = list(gif_frames(gif(frames, colours)))
    assert len(got) == 3 and all((g == np.array(colours, np.uint8)[f]).all() for g, f in zip(got, frames, strict=True))
    with pytest.raises(ValueError):
        list(gif_frames(b"PNG"))


@pytest.mark.parametrize("n,s,want", [(3, 12, [0, 1, 2]), (5, 1, [0, 1, 2, 3, 4]), (13, 12, [0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12]), (6, 2, [0, 5]), (0, 4, [])])
def test_sample_places(n, s, want):
    assert sample_places(n, s) == want


@pytest.fixture
def folder(tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.png").write_bytes(png(picture(i)))
    (tmp_path / "bad.png").write_bytes(b"\x89PNG nothing")
    (tmp_path / "note.txt").write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "q.PNG").write_bytes(png(picture(7)))
    return tmp_path


def test_listing(spark, folder):
    names = [r["name"] for r in list_media(spark, f"file://{folder}").collect()]
    assert names == ["bad.png", "p0.png", "p1.png", "p2.png"]
    assert list_media(spark, f"file://{folder}", recursive=True).count() == 5
    assert list_media(spark, f"file://{folder}/none.png").first()["load_error"] == "FileNotFoundError"
    assert list_media(spark, "https://a/b.png").first()["source_kind"] == "url"


def test_images_hash_like_their_pixels(spark, folder):
    got = {r["media_id"].rsplit("/", 1)[-1]: (r["h"], r["load_error"]) for r in read_images(spark, f"file://{folder}").select("media_id", hash_of_image("image").alias("h"), "load_error").collect()}
    assert got["p1.png"] == (hash_pixels(picture(1)), None)
    assert got["bad.png"] == (None, "undecodable")


def test_animation_hashes(spark):
    frames = [np.random.default_rng(i).integers(0, 4, (8, 8)) for i in range(5)]
    content = gif(frames, [(0, 0, 0), (255, 255, 255), (90, 90, 90), (160, 160, 160)])
    rows = animation_hashes(spark.createDataFrame([("a", bytearray(content)), ("b", bytearray(b"junk"))], "media_id string, content binary"), 3).collect()
    assert [r["idx"] for r in rows if r["media_id"] == "a"] == [0, 2, 4]
    assert [r["load_error"] is not None for r in rows if r["media_id"] == "b"] == [True]


def test_hash_list_file(spark, tmp_path):
    (tmp_path / "l.txt").write_bytes(b"# c\r\nABCDEF0123456789, bad \r\n\r\nzz,1\r\nabc\r\n")
    got = [(r["hex"], r["label"], r["hex_len"], r["bits"] is None) for r in read_hash_list(spark, f"file://{tmp_path}/l.txt", "block").collect()]
    assert got == [("abcdef0123456789", "bad", 16, False), ("abc", "block", 3, True)]
    assert read_hash_list(spark, f"file://{tmp_path}/none.txt", "block").count() == 0
    new = spark.createDataFrame([("ABCDEF0123456789", "again"), ("00ff00ff00ff00ff", "n")], "hex string, label string")
    fresh = matching.insert_if_absent(new, read_hash_list(spark, f"file://{tmp_path}/l.txt", "block"))
    append_hashes(fresh, f"file://{tmp_path}/grown")
    append_hashes(spark.createDataFrame([("00FF00FF00FF00FF", "late"), ("0000000000000001", "z")], "hex string, label string").coalesce(1), f"file://{tmp_path}/grown")
    grown = read_hash_store(spark, f"file://{tmp_path}/grown").orderBy("line_no").collect()
    assert [(r["hex"], r["label"], r["bits"]) for r in grown] == [("00ff00ff00ff00ff", "n", 0x00FF00FF00FF00FF), ("0000000000000001", "z", 1)]


def test_nearest_match_ties_and_limits(spark):
    h = spark.createDataFrame([("a", 0), ("b", 127), ("c", -1)], "media_id string, bits bigint")
    e = spark.createDataFrame([(5, "late", 1), (2, "first", 2), (9, "far", 63)], "line_no bigint, label string, bits bigint")
    got = {r["media_id"]: (r["distance"], r["match_label"]) for r in matching.nearest_match(h, e, 6).collect()}
    assert got == {"a": (1, "first"), "b": (1, "far")}
    assert {r["media_id"]: r["distance"] for r in matching.nearest_match(h, e, 64).collect()} == {"a": 1, "b": 1, "c": 58}


def test_patterns_in_order(spark):
    patterns = text.usable_patterns(["# c", "", "b(", "re:a", "A+"])
    assert patterns == ["b\\(", "re:a", "A+"]
    assert text.usable_patterns(["re:a"], strip_prefix=True) == ["a"]
    df = spark.createDataFrame([("1", "xx B( aa"), ("2", "aaa"), ("3", "aa"), ("4", None)], "id string, t string")
    got = {r["id"]: r["hit"] for r in text.text_check(df, "id", "t", patterns).collect()}
    assert got == {"1": "b\\(", "2": "A+", "3": None, "4": None}


def test_settings_lines(tmp_path):
    assert settings.parse_line("export A = 'x # y' ") == ("A", "x # y")
    assert settings.parse_line("set B=1 # note") == ("B", "1")
    assert settings.parse_line("# C=1") is None and settings.parse_line("nothing") is None
    (tmp_path / ".env").write_text("A=1\nFINAL_BLOCK_THRESHOLD=nan\nAPI_POLICY=uncertain\nCORE_ENGINES=ocr\n")
    env = settings.load(tmp_path, {"A": "0"})
    run = settings.resolve(env)
    assert env["A"] == "0" and run.settings.block == 0.85 and run.route.api_policy == "on_review" and run.settings.core == ("OCR text",)
    assert settings.load(tmp_path, {"A": "0", "DOTENV_OVERRIDE": "yes"})["A"] == "1"


@pytest.mark.parametrize("how,ok,block", [({}, False, False), ({"block": True}, False, False), ({"append": True, "block": True}, False, True), ({"enabled": True}, True, True), ({"enabled": True, "allow": False}, False, True), ({"enabled": False, "append": True, "allow": True}, False, False), ({"allow": True}, True, False)])
def test_learning_switches(how, ok, block):
    learning = routing.Learning(**how)
    assert (learning.learns("OK"), learning.learns("BLOCK"), learning.learns("REVIEW")) == (ok, block, False)


def _media(spark):
    rows = [("a", 0, None, "x"), ("b", 1, None, "heil hitler"), ("c", 1 << 40, None, ""), ("d", None, "OSError", None)]
    return spark.createDataFrame(rows, "media_id string, bits bigint, load_error string, text string")


@pytest.mark.parametrize("policy,asked", [("always", {"b", "c"}), ("on_review", {"c"}), ("never", set())])
def test_stages(spark, policy, asked):
    media = _media(spark)
    listed = spark.createDataFrame([(1, "known", 0)], "line_no bigint, label string, bits bigint")
    local_scores = spark.createDataFrame([("b", {"nsfw_probability": 0.95}), ("c", {"nsfw_probability": 0.45})], "media_id string, scores map<string,double>")
    seen = []

    def ask(m):
        seen.append({r["media_id"] for r in m.select("media_id").collect()})
        return table_engine("Sightengine", m.select("media_id", F.create_map(F.lit("offensive_max"), F.lit(1.0)).alias("scores"))).results(m)

    pre = lambda m: run_engines(m, [blocklist_engine(listed, 0), allowlist_engine(listed.limit(0))])
    local = lambda m: run_engines(m, [table_engine("OpenNSFW2", local_scores), text_engine([]), Engine("NudeNet", lambda x: x, False, "not installed")])
    out = {r["media_id"]: r["label"] for r in routing.moderate(media, pre, local, ask, route=routing.Route(api_policy=policy)).collect()}
    assert out == {"a": "BLOCK", "b": "BLOCK", "c": "BLOCK" if "c" in asked else "REVIEW", "d": "REVIEW"}
    assert seen == ([asked] if asked else [])


def test_stream_learns_between_batches(spark, folder, tmp_path):
    land, known = tmp_path / "land", []
    land.mkdir()
    (land / "p0.png").write_bytes(png(picture(0)))

    def moderate(batch):
        return batch.select("media_id", F.lit("OK").alias("label"))

    def learn(verdicts):
        known.extend(r["media_id"] for r in verdicts.collect())

    for i in range(2):
        (land / f"n{i}.png").write_bytes(png(picture(i)))
        moderate_stream(arriving_files(spark, f"file://{land}"), moderate, f"file://{tmp_path}/v", f"file://{tmp_path}/cp", learn).awaitTermination()
    assert sorted(x.rsplit("/", 1)[-1] for x in known) == ["n0.png", "n1.png", "p0.png"]


def test_command_line(spark, folder, tmp_path, capsys):
    (tmp_path / "block.txt").write_text(hash_pixels(picture(1)) + ",seen\n")
    (tmp_path / "allow.txt").write_text(hash_pixels(picture(0)) + "\n" + hash_pixels(picture(2)) + "\n")
    to = tmp_path / "r.json"
    code = cli.main([f"file://{folder}", "--blocklist", f"file://{tmp_path}/block.txt", "--allowlist", f"file://{tmp_path}/allow.txt", "--json", str(to)])
    rows = {r["name"]: r["verdict"] for r in json.loads(to.read_text())}
    assert code == 2 and rows["p1.png"]["label"] == "BLOCK" and rows["p0.png"]["label"] == "OK" and rows["bad.png"]["label"] == "REVIEW"
    assert rows["p1.png"]["reasons"] == ["Blocklist match (distance=0)"]
    (tmp_path / "empty").mkdir()
    assert cli.main([f"file://{tmp_path}/empty"]) == 2


def test_a_run_learns_for_itself_and_the_next(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("PHASH_AUTO_LEARN_ENABLE", "1")
    media, to = tmp_path / "media", tmp_path / "r.json"
    media.mkdir()
    for name, seed in (("a", 1), ("b", 2), ("c", 1), ("d", 3)):
        (media / f"{name}.png").write_bytes(png(picture(seed)))
    (tmp_path / "block.txt").write_text(hash_pixels(picture(2)) + ",seen\n")
    call = [f"file://{media}", "--blocklist", f"file://{tmp_path}/block.txt", "--allowlist", f"file://{tmp_path}/allow.txt", "--json", str(to)]
    for reasons in ({"a": [], "b": ["Blocklist match (distance=0)"], "c": ["Allowlist match (distance=0)"], "d": []}, {"a": ["Allowlist match (distance=0)"], "b": ["Blocklist match (distance=0)"], "c": ["Allowlist match (distance=0)"], "d": ["Allowlist match (distance=0)"]}):
        assert cli.main(call) == 2
        assert {r["name"][0]: r["verdict"]["reasons"] for r in json.loads(to.read_text())} == reasons
        got = {kind: {r["hex"]: r["label"] for r in read_hash_store(spark, f"file://{tmp_path}/{kind}.txt.learned").collect()} for kind in ("block", "allow")}
        assert got == {"block": {}, "allow": {hash_pixels(picture(1)): "ok", hash_pixels(picture(3)): "ok"}}


def test_benchmark_of_a_run(spark, folder, tmp_path, capsys, monkeypatch):
    (tmp_path / "block.txt").write_text(hash_pixels(picture(1)) + ",seen\n")
    to, lines = tmp_path / "bench.json", tmp_path / "rows"
    monkeypatch.setattr(cli, "MOST_SHOWN", 2)  # reports of more inputs are written by Spark
    code = cli.main([f"file://{folder}", "--blocklist", f"file://{tmp_path}/block.txt", "--allowlist", "none", "--json", f"file://{lines}", "--benchmark", "--benchmark-json", str(to)])
    got, told = json.loads(to.read_text()), capsys.readouterr().out
    assert code == 2 and got["total_files"] == 4 and sum(got["verdict_counts"].values()) == 4 and got["verdict_counts"]["BLOCK"] == 1
    engines = {e["engine"]: e for e in got["engines"]}
    assert (engines["pHash blocklist"]["ok"], engines["pHash allowlist"]["skipped"], engines["pHash blocklist"]["runs"]) == (3, 3, 3)
    slow = {f["media_id"].rsplit("/", 1)[-1]: f for f in got["slowest_files"]}
    assert [e["name"] for e in slow["p1.png"]["engines"]] == ["pHash blocklist", "pHash allowlist"] and slow["bad.png"]["engine_count"] == 0
    assert "files 4" in told and "verdicts OK" in told and "engine pHash blocklist: runs 3, ok 3" in told and "slow " in told
    assert spark.read.json(f"file://{lines}").count() == 4


def test_bits_of_hex_feed_the_lists(spark):
    assert spark.range(1).select(bits_of_hex(F.lit("8000000000000000"))).first()[0] == -(1 << 63)


@pytest.mark.parametrize("codes,calls,waits", [([200], 1, []), ([429, 429, 200], 3, [1, 2]), ([429] * 9, 4, [1, 2, 4]), ([500, 200], 1, [])])
def test_only_429_is_tried_again(codes, calls, waits):
    answers, slept = iter(codes), []
    status, _, n = remote.send(lambda p: (next(answers), ""), "x", remote.Pace(jitter=0), slept.append)
    assert (n, slept, status) == (calls, waits, codes[calls - 1])


def test_total_wait_is_bounded():
    slept = []
    remote.send(lambda p: (429, ""), "x", remote.Pace(jitter=0, retries=20, total=10), slept.append)
    assert slept == [1, 2, 4]


@pytest.mark.parametrize(
    "style,status,body,want",
    [("moderation", 401, "", ("skipped", True)), ("moderation", 500, "", ("skipped", False)), ("moderation", 200, "{}", ("ok", False)), ("frames", 402, "", ("skipped", True)), ("frames", 500, "x", ("error", False)), ("frames", 200, "{", ("error", False)), ("frames", 200, '{"status": "failure", "error": {"message": "usage limit"}}', ("skipped", True)), ("frames", 200, '{"status": "success"}', ("ok", False))],
)
def test_answers(style, status, body, want):
    got = remote.judge(style, status, body)
    assert (got[0], got[2]) == want


def test_calls_stop_after_a_refusal(spark):
    requests = spark.createDataFrame([(str(i), "p") for i in range(5)], "media_id string, payload string").coalesce(1)
    got = remote.call_remote(requests, lambda p: (403, ""), "frames", remote.Pace(interval=0))
    assert {(r["status"], r["calls"]) for r in got.collect()} == {("skipped", 1), ("skipped", 0)}


def test_fetching(spark):
    urls = spark.createDataFrame([("a", "https://h/x/pic"), ("b", "https://h/page.html"), ("c", "https://down")], "media_id string, url string")

    def transport(url, limit):
        if "down" in url:
            raise OSError("no route")
        return ("text/html", None, b"<html>") if "page" in url else ("", 9, b"\x89PNG\r\n\x1a\n....")

    got = {r["media_id"]: (r["error"], r["ext"], r["name"]) for r in remote.fetch(urls, transport, 1).collect()}
    assert got == {"a": (None, ".png", "pic"), "b": ("not_an_image", None, None), "c": ("OSError: no route", None, None)}


def test_models(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "real.pt").write_bytes(b"\0" * 3800)
    (tmp_path / "ptr.pt").write_text("version https://" + models.POINTER + "/v1\noid sha256:1\n")
    assert models.resolve("real.pt", tmp_path) == (tmp_path / "real.pt", None)
    assert models.resolve("ptr.pt", tmp_path / "elsewhere")[1] == "pointer"
    assert models.resolve("no.pt", tmp_path)[0] is None and len(models.candidates("no.pt", tmp_path)) == 1
    assert models.weapon_model({"YOLO_WORLD_MODEL": " ", "YOLO_WEAPON_MODEL": "w.pt", "YOLO_WEAPONS_WEIGHTS": "v"}) == "w.pt"
    assert models.weapon_model({"YOLO_WORLD_MODEL": "YOLO-World"}) is None


def test_cache_file(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"k1": {"scores": {"a": 0.5}, "details": {}}, "k2": {"scores": {}}}')
    (tmp_path / "bad.json").write_text("{not json")
    assert [(r["key"], r["seq"]) for r in read_cache(spark, f"file://{tmp_path}/c.json").collect()] == [("k1", 0), ("k2", 1)]
    assert read_cache(spark, f"file://{tmp_path}/bad.json").count() == read_cache(spark, f"file://{tmp_path}/no.json").count() == 0


@pytest.mark.parametrize(
    "engine,how,want",
    [
        ("other", {"most": 2}, ["b", "d"]),
        ("other", {"verbose": True}, ["a", "b", "nudity_raw", "d"]),
        ("Sightengine", {}, ["nudity_raw"]),
        ("Sightengine", {"mode": "full"}, ["a", "b", "nudity_raw", "d"]),
        ("Sightengine", {"mode": "keys", "keys": ("d", "none", "a")}, ["d", "a"]),
        ("Sightengine", {"extra": 3}, ["nudity_raw", "b", "d"]),
        ("YOLO forbidden symbols", {}, []),
    ],
)
def test_shown_scores(spark, engine, how, want):
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("a", 0.01), ("b", 0.9), ("nudity_raw", 0.3), ("d", 0.9))])
    assert [e["key"] for e in spark.range(1).select(shown_scores(engine, entries, **how).alias("s")).first()["s"]] == want


def test_reports(tmp_path):
    report.write_json([], tmp_path / "a", 0)
    report.write_json([{"name": "ü"}], tmp_path / "b", 1)
    report.write_json([{"name": "x"}, {"name": "y"}], tmp_path / "c", 2)
    assert json.loads((tmp_path / "a").read_text())["results"] == [] and "ü" in (tmp_path / "b").read_text()
    assert isinstance(json.loads((tmp_path / "b").read_text()), dict) and len(json.loads((tmp_path / "c").read_text())) == 2
    assert (report.exit_status([]), report.exit_status(["OK"]), report.exit_status(["OK", "REVIEW"])) == (2, 0, 2)
    summary = {"total_files": 1, "total_ms": 5, "total_wall_ms": 5, "avg_file_ms": 5.0, "median_file_ms": 5, "p95_file_ms": 5}
    assert report.summary_lines(summary, [], [{"media_id": "m", "total_ms": 5}])[1] == "slow m: 5 ms"


def test_engine_stages():
    first, local, far = engines.stages({"OPENAI_DISABLE": "on"})
    assert first == ["pHash blocklist", "pHash allowlist"] and local[0] == "OCR text" and far == ["Sightengine"]
    assert engines.stages({}, no_apis=True)[2] == []
    assert engines.switched_off("OCR text", {"OCR_ENABLE": "true"}) and not engines.switched_off("OCR text", {"OCR_ENABLE": "1"})
    assert engines.switched_off("NudeNet", {"NUDENET_DISABLE": "1"}) and not engines.switched_off("NudeNet", {"NUDENET_DISABLE": "true"})
