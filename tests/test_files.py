import __spark_entry__ as entry


def test_tokens_of_all_files_and_their_folders(spark, tmp_path):
    # a video and an audio file count as well, and so do folders below /archive
    rows = [(1, 1, "/archive/a-b/Pier/clip_1.mov", "clip_1.mov", "video"), (2, 1, "/archive/b/Pier/clip/deep_2.jpg", "deep_2.jpg", "image"), (3, 2, "/archive/clip.wav", "clip.wav", "audio")]
    spark.createDataFrame(rows + rows[:1], "id long, source_id long, path string, filename string, file_type string").write.parquet(f"{tmp_path}/files.parquet")
    got = {r["token"]: (r["frequency"], r["n_files"], r["depth"], r["cross_source"]) for r in entry.queries()["relative_path_tokens"](spark, str(tmp_path)).collect()}
    assert got["clip"] == (3, 3, 2, True) and got["pier"] == (2, 2, 2, False) and got["deep"] == (1, 1, 3, False) and got["wav"] == (1, 1, 0, False) and "archive" not in got
    got = {tuple(r) for r in entry.queries()["relative_path_bigrams"](spark, str(tmp_path)).collect()}
    assert got == {("b pier", 2, 2), ("pier clip", 2, 2)}
