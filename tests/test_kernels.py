import colorsys

import numpy as np
from pyspark.sql import functions as F

from mosaicry.operators.kernels import distinct_frames, frame_quality, has_speech, image_quality, leaders, mean_metrics, merged_centroid, normalised_samples, peak, sample_times


def test_image_measures(spark):
    red = np.zeros((4, 4, 3), np.uint8)
    red[..., 0] = 255
    q = frame_quality(red)
    assert q[0] == 0 and q[5] == 1.0 and q[6] == 5.0 and abs(q[1] - 0.299) < 1e-9
    rnd = np.random.default_rng(1).integers(0, 256, (6, 5, 3)).astype(np.uint8)
    hues = [int(colorsys.rgb_to_hsv(*(p / 255))[0] * 360 // 10) % 36 for p in rnd.reshape(-1, 3).astype(float)]
    assert (frame_quality(rnd)[6] - 5) / 10 in {h for h in hues if hues.count(h) == max(map(hues.count, hues))}
    df = spark.createDataFrame([(1, bytearray(red.tobytes()), 4, 4), (2, bytearray(b"xx"), 4, 4), (3, None, 4, 4)], "i long, px binary, w int, h int")
    got = {r["id"]: r["saturation_mean"] for r in image_quality(df, "i", "px", "w", "h").collect()}
    assert got[1] == 1.0 and got[2] is None and got[3] is None
    m = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, None)], "k int, x double")
    assert {tuple(r) for r in mean_metrics(m, "k", ["x"]).collect()} == {(1, 2.0), (2, None)}


def test_sound_measures(spark):
    df = spark.createDataFrame([([0] * 50 + [20000] * 50,), ([1] * 100,), ([],), ([32767, -32768],)], "s array<int>")
    rows = df.select(has_speech(F.col("s"), 100, -20.0).alias("v"), peak(F.col("s")).alias("p"), normalised_samples(F.col("s")).alias("n"), sample_times(F.lit(1000), 3).alias("t")).collect()
    assert [r["v"] for r in rows] == [True, False, False, True]
    assert rows[3]["p"]["clipped"] and rows[2]["p"]["peak_db"] is None and rows[0]["n"][-1] == 32767 and rows[0]["t"] == [250, 500, 750]


def test_frames_are_kept_against_the_last_kept(spark):
    df = spark.createDataFrame([(["0000000000000000", "0000000000000001", "0000000000000003", "00000000000000ff"],), ([],)], "h array<string>")
    assert [r[0] for r in df.select(distinct_frames(F.col("h"), 1)).collect()] == [["0000000000000000", "0000000000000003", "00000000000000ff"], []]


def test_leaders(spark):
    rows = [(1, 7, 0, [1.0, 0.0]), (2, 7, 1, [0.9, 0.1]), (3, 7, 2, [0.0, 1.0]), (4, 7, 3, [0.1, 0.9]), (5, 8, 0, [1.0, 0.0]), (6, 8, 1, [0.0, 0.0]), (7, 8, 2, None), (8, None, 0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, f long, o int, v array<float>")
    assert {(r["id"], r["f"], r["leader"]) for r in leaders(df, "f", "id", "o", "v", 0.8).collect()} == {(1, 7, 1), (2, 7, 1), (3, 7, 3), (4, 7, 3), (5, 8, 5)}
    c = spark.createDataFrame([([1.0, 0.0], 3, [0.0, 1.0], 4)], "a array<float>, n int, b array<float>, m int")
    got = c.select(merged_centroid(F.col("a"), F.col("n"), F.col("b"), F.col("m")).alias("c")).first()["c"]
    assert [round(x, 5) for x in got] == [0.6, 0.8]


def test_leaders_are_the_same_whatever_the_block(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((4, 8))
    rows = [(i, i % 3 // 2, i, (base[rng.integers(4)] + 0.4 * rng.standard_normal(8)).tolist() if i % 7 else [0.0] * 8) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, f long, o int, v array<float>")
    fold = lambda block: sorted((r["id"], r["f"], r["leader"], round(r["similarity"], 9)) for r in leaders(df, "f", "id", "o", "v", 0.75, block=block).collect())
    whole = fold(5_000)
    assert len(whole) == sum(1 for r in rows if any(r[3])) and fold(13) == whole and fold(20) == whole
