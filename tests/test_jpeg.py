"""JPEG payloads read back by Spark's image source."""

import numpy as np
import pytest

from mediasift.functions.jpeg import BRIGHTNESS, COLOUR, ZIGZAG, code_lengths, encode_jpeg, quantisation, with_jpeg


def images():
    rng = np.random.default_rng(3)
    y, x = np.mgrid[0:50, 0:37]
    smooth = np.stack([127 + 100 * np.sin(x / 9), 127 + 100 * np.cos(y / 7), 127 + 100 * np.sin((x + y) / 11)], 2).astype(np.uint8)
    return {"smooth": smooth, "flat": np.full((8, 8, 3), 77, np.uint8), "one": np.array([[[200, 10, 90]]], np.uint8), "noise": rng.integers(0, 256, (40, 64, 3)).astype(np.uint8), "wide": np.repeat(smooth, 20, axis=1), "black": np.zeros((17, 3, 3), np.uint8)}


def read_back(spark, folder):
    rows = spark.read.format("image").load(f"file://{folder}").select("image.*").collect()
    return {r["origin"].rsplit("/", 1)[-1][:-4]: np.frombuffer(bytes(r["data"]), np.uint8).reshape(r["height"], r["width"], 3)[:, :, ::-1] for r in rows}


def stated_error(quality):
    """Mean error of a channel: coefficients are off by half a step at most, and the transform keeps lengths."""
    steps = [np.sqrt((quantisation(t, quality) ** 2).mean()) / 2 for t in (BRIGHTNESS, COLOUR)]
    return steps[0] + 1.772 * steps[1] + 2


@pytest.mark.parametrize("quality", [90, 30])
def test_image_source_reads_what_was_written(spark, tmp_path, quality):
    for name, rgb in images().items():
        (tmp_path / f"{name}.jpg").write_bytes(encode_jpeg(rgb, quality))
    got = read_back(spark, tmp_path)
    for name, rgb in images().items():
        assert got[name].shape == rgb.shape
        error = np.abs(got[name].astype(int) - rgb)
        assert error.mean() <= stated_error(quality) and (quality < 90 or name == "noise" or error.mean() < 3)


def test_grey_and_impossible_sizes(spark, tmp_path):
    grey = images()["smooth"][:, :, 0]
    (tmp_path / "grey.jpg").write_bytes(encode_jpeg(grey))
    assert np.abs(read_back(spark, tmp_path)["grey"].astype(int) - grey[:, :, None]).mean() < 2
    with pytest.raises(ValueError):
        encode_jpeg(np.zeros((0, 5, 3), np.uint8))


def test_codes_are_prefix_codes_of_limited_length():
    for counts in ({7: 1}, {i: 1 << i for i in range(40)}, {i: 1 for i in range(162)}):
        lengths = code_lengths(counts)
        assert set(lengths) == set(counts) and max(lengths.values()) <= 16
        assert sum(2.0**-n for n in lengths.values()) < 1  # the code of all ones is free
    assert ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


def test_column(spark):
    rows = [(1, 2, 1, bytes(6), "x"), (2, 1, 1, None, "y")]
    got = with_jpeg(spark.createDataFrame(rows, "id long, width int, height int, pixels binary, jpeg string")).collect()
    assert [(r["id"], r["jpeg"] is None) for r in got] == [(1, False), (2, True)] and bytes(got[0]["jpeg"]) == encode_jpeg(np.zeros((1, 2, 3), np.uint8))
