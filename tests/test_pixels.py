"""Measures of pixels against loops over single pixels."""

import math

import numpy as np
import pytest

from shutterlake.functions import pixels
from shutterlake.operators import documents, pictures
from shutterlake.sources import media
from tests.test_operators import png


def page(h=300, w=420):
    """Paper with level lines of writing on a dark table."""
    out = np.full((h, w, 3), 40, dtype=np.uint8)
    out[40 : h - 40, 10 : w - 10] = 235
    for y in range(60, h - 60, 12):
        out[y : y + 4, 40 : w - 40] = 20
    return out


def meadow(h=300, w=420):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([30 + 0 * x, 150 + 60 * np.sin(x / 40 + y / 50), 40 + 0 * x], axis=2).astype(np.uint8)[:, :, ::-1]


def test_candidates_from_pixels(spark, tmp_path):
    for name, p in (("a.png", page()), ("b.png", meadow()), ("c.png", page())):
        png(tmp_path / name, p)
    feats = media.pixel_features(media.pixel_source(spark, str(tmp_path))).cache()
    rows = {r.origin.rsplit("/", 1)[1]: r for r in feats.collect()}
    shown = feats.selectExpr("regexp_extract(origin, '[^/]*$', 0) AS filename", "'image/png' AS mime_type", "CAST(null AS STRING) AS extracted_text", "saturation", "white_ratio", "dark_ratio", "edge_density", "hv_ratio")
    assert sorted(r.filename for r in shown.filter(documents.document_candidate(shown)).collect()) == ["a.png", "c.png"]
    a, b = rows["a.png"], rows["b.png"]
    assert a.outline.page and a.outline.top > 12 and a.outline.bottom < 388 and a.blur_score > b.blur_score and a.saturation < 0.05 < 0.5 < b.saturation
    ids = feats.selectExpr("ascii(regexp_extract(origin, '[^/]*$', 0)) - 97 AS id", "grid")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 9)], "a int, b int")
    got = {(r.a, r.b): r.ssim for r in pictures.structural_pairs(pairs, ids).collect()}
    assert set(got) == {(0, 1), (0, 2)} and got[0, 2] == pytest.approx(1) and got[0, 1] < 0.5
    assert [(r.a, r.b) for r in pictures.structural_pairs(pairs, ids, 0.9).collect()] == [(0, 2)]
    assert pictures.structural_pairs(pairs.limit(0), ids).count() == 0


def test_small_pictures(spark, tmp_path):
    png(tmp_path / "dot.png", np.full((1, 1, 3), 200, dtype=np.uint8))
    png(tmp_path / "row.png", np.full((2, 700, 3), 0, dtype=np.uint8))
    rows = media.pixel_features(media.pixel_source(spark, str(tmp_path))).collect()
    assert len(rows) == 2 and all(r.edge_density == 0 and r.hv_ratio == 1 and r.blur_score == 0 and sum(r.color_histogram) == pytest.approx(1) for r in rows)


def test_ssim_of_nulls_and_sizes(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [1.0, 2.0]), (2, None, [1.0]), (3, [1.0], [1.0, 2.0]), (4, [], [])], "id int, x array<double>, y array<double>")
    got = {r.id: r.s for r in df.select("id", pixels.ssim(df.x, df.y).alias("s")).collect()}
    assert got[1] == pytest.approx(1) and got[2] is None and got[3] == got[4] == 0


def test_measures_equal_loops():
    rng = np.random.default_rng(5)
    grey = rng.integers(0, 256, (90, 160)).astype(float)
    bgr = np.stack([grey, np.roll(grey, 3), np.roll(grey, 9)], axis=2)
    h, w = grey.shape
    got = pixels.document_tones(bgr, grey)
    n = dict.fromkeys(("white", "dark", "edge", "level", "upright"), 0)
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            gx, gy = abs(grey[y, x + 1] - grey[y, x - 1]), abs(grey[y + 1, x] - grey[y - 1, x])
            for k, hit in zip(n, (grey[y, x] > 210, grey[y, x] < 50, gx + gy > 30, gy > 20, gx > 20), strict=True):
                n[k] += hit
    assert (got["white_ratio"], got["dark_ratio"], got["edge_density"]) == tuple(pytest.approx(n[k] / (h * w)) for k in ("white", "dark", "edge"))
    assert got["hv_ratio"] == pytest.approx(n["level"] / n["upright"])
    laps = [grey[y - 1, x] + grey[y + 1, x] + grey[y, x - 1] + grey[y, x + 1] - 4 * grey[y, x] for y in range(1, h - 1) for x in range(1, w - 1)]
    mean = sum(laps) / (h * w)
    assert pixels.sharpness(grey) == (pytest.approx(np.var(laps)), pytest.approx(sum((v - mean) ** 2 for v in laps) / (h * w)))
    square = rng.integers(0, 256, (64, 64)).astype(float)
    bins = [0] * 32
    for y in range(1, 63):
        for x in range(1, 63):
            gx, gy = square[y, x + 1] - square[y, x - 1], square[y + 1, x] - square[y - 1, x]
            if math.hypot(gx, gy) > 20:
                angle = math.degrees(math.atan2(gy, gx))
                bins[min(31, int((angle + 180 if angle < 0 else angle) / 180 * 32))] += 1
    assert pixels.edge_histogram(square) == pytest.approx(np.array(bins) / sum(bins))
    red = np.zeros((48, 48, 3))
    red[:, :, 2] = 255
    assert pixels.color_histogram(red)[0 * 8 + 3 * 2 + 1] == 1
    blue = red[:, :, ::-1]
    assert pixels.color_histogram(blue)[(240 // 45) * 8 + 3 * 2 + 1] == 1 and pixels.color_histogram(0 * red)[0] == 1
