"""Frames as a data source: what is decoded, what is dropped."""

import numpy as np
import pytest

from mediasift.functions.imagehash import hash_pixels
from mediasift.sources.frames_source import PushingReader, read_frames
from mediasift.sources.gif import Animation, gif_frames
from tests.test_media import gif

COLOURS = [(0, 0, 0), (255, 255, 255), (90, 90, 90), (160, 160, 160)]


def pictures(n, seed=0):
    return [np.random.default_rng(seed + i).integers(0, 4, (8, 8)) for i in range(n)]


def block(picture):
    """The image block of one picture, without what stands before and after it."""
    content = gif([picture], COLOURS)
    return content[content.index(b"\x2c", 13 + 12) : -1]


HEAD = gif(pictures(1), COLOURS)[: 13 + 12]


def animation(specs, seed=0, broken=()):
    """A GIF of 8 x 8 frames with the given (dispose, clear index); of broken ones the pixels are missing."""
    out = HEAD
    for i, ((dispose, clear), p) in enumerate(zip(specs, pictures(len(specs), seed), strict=True)):
        image = block(p)
        out += bytes([0x21, 0xF9, 4, dispose << 2 | (clear is not None), 0, 0, clear or 0, 0])
        out += image[:11] + b"\x01\x04\x00" if i in broken else image
    return out + b"\x3b"


def plain(specs, seed=0):
    """The pictures, one after the other."""
    canvas, out = np.zeros((8, 8, 3), np.uint8), []
    for (dispose, clear), p in zip(specs, pictures(len(specs), seed), strict=True):
        before = canvas.copy()
        drawn = p != clear if clear is not None else np.ones(p.shape, bool)
        canvas[drawn] = np.array(COLOURS, np.uint8)[p][drawn]
        out.append(canvas.copy())
        canvas = np.zeros_like(canvas) if dispose == 2 else before if dispose == 3 else canvas
    return out


@pytest.mark.parametrize("seed", range(6))
def test_any_frame_equals_the_plain_sequence(seed):
    rng = np.random.default_rng(seed)
    specs = [(int(rng.choice([0, 1, 2, 3])), None if rng.random() < 0.3 else int(rng.integers(4))) for _ in range(9)]
    content, want = animation(specs, seed), plain(specs, seed)
    assert all((a == b).all() for a, b in zip(gif_frames(content), want, strict=True))
    for i in rng.permutation(9).tolist():
        assert (Animation(content).frame(i) == want[i]).all()
    again = Animation(content)
    assert all((again.frame(i) == want[i]).all() for i in [5, 2, 2, 8, 0])


def test_only_what_a_picture_depends_on_is_decoded():
    whole = Animation(animation([(0, None)] * 20))  # each frame is drawn over everything
    for i in (0, 10, 19):
        whole.frame(i)
    assert whole.decoded == 3
    layers = Animation(animation([(0, 1)] * 20))  # each frame lets those below show
    layers.frame(10)
    layers.frame(19)
    assert layers.decoded == 20
    taken_back = Animation(animation([(3, 1)] * 20))
    taken_back.frame(19)
    assert taken_back.decoded == 1


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.gif").write_bytes(animation([(0, None)] * 20))
    (tmp_path / "broken.gif").write_bytes(animation([(0, None)] * 5, broken=(2,)))
    (tmp_path / "hopeless.gif").write_bytes(animation([(0, None)] * 2, broken=(0, 1)))
    (tmp_path / "cut.gif").write_bytes(b"GIF89a")
    (tmp_path / "junk.gif").write_bytes(b"junk")
    (tmp_path / "note.txt").write_text("x")
    return tmp_path


def test_rows(spark, folder):
    rows = read_frames(spark, str(folder), 5).collect()
    by = {}
    for r in rows:
        by.setdefault(r["media_id"].rsplit("/", 1)[-1], []).append(r)
    assert [(r["pos"], r["idx"], r["n_frames"]) for r in by["a.gif"]] == [(0, 0, 20), (1, 5, 20), (2, 10, 20), (3, 14, 20), (4, 19, 20)]
    want = plain([(0, None)] * 20)
    assert all(r["hash_hex"] == hash_pixels(want[r["idx"]]) and bytes(r["pixels"]) == want[r["idx"]].tobytes() for r in by["a.gif"])
    assert by["a.gif"][-1]["decoded"] == 5
    assert [r["idx"] for r in by["broken.gif"]] == [0, 1, 3, 4] and [r["pos"] for r in by["hopeless.gif"]] == [None]
    assert [(r["pos"], r["n_frames"]) for r in by["junk.gif"]] == [(None, 0)] and "not a GIF" in by["junk.gif"][0]["load_error"]
    assert set(by) == {"a.gif", "broken.gif", "cut.gif", "hopeless.gif", "junk.gif"} and read_frames(spark, f"{folder}/none").count() == 0


def test_conditions_and_columns_reach_the_source(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        frames = read_frames(spark, str(folder), 12)
        some = frames.filter("pos > 4 and pos < 7 and load_error is null")
        last = some.filter(some["media_id"] == f"{folder}/a.gif").collect()
        assert [r["pos"] for r in last] == [5, 6] and last[-1]["decoded"] == 2
        assert "pos" in some._jdf.queryExecution().executedPlan().toString()
        assert frames.filter("idx in (19)").count() == 1
        nothing = read_frames(spark, str(folder), 12, schema="media_id string, n_frames int, pos int, idx int")
        assert nothing.filter("media_id like '%a.gif'").count() == 12
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
        assert [r["decoded"] for r in read_frames(spark, str(folder), 12).filter("pos in (5, 6) and media_id like '%a.gif'").collect()] == [6, 7]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def test_a_reader_reads_no_other_files(folder):
    from pyspark.sql.datasource import EqualTo, In
    from pyspark.sql.types import StructType

    reader = PushingReader(StructType().add("media_id", "string").add("idx", "integer"), str(folder), 12, False)
    assert list(reader.pushFilters([EqualTo(("media_id",), f"{folder}/a.gif"), In(("n_frames",), (1,))])) == [In(("n_frames",), (1,))]
    assert [p.paths for p in reader.partitions()] == [[f"{folder}/a.gif"]]
    assert len(list(reader.read(reader.partitions()[0]))) == 12
