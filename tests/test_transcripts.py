import __spark_entry__ as entry


def test_segments_without_a_start_stay_in_the_text(spark, tmp_path):
    seg = [(1, 5, 2000, "two", None), (2, 5, None, "[00:00:01.5] one", "Ann"), (3, 5, None, "last", None), (4, 6, None, "0:00:03 - b", None), (5, 6, None, "(00:02) a", None), (6, 6, 1000, " ", None)]
    spark.createDataFrame(seg, "id long, file_id long, start_ms long, text string, speaker_label string").write.parquet(f"{tmp_path}/transcript_segments.parquet")
    spark.createDataFrame([(5, "f", "audio"), (6, "g", "audio"), (7, "h", "audio")], "id long, filename string, file_type string").write.parquet(f"{tmp_path}/files.parquet")
    spark.createDataFrame([], "doc_id long, file_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "file_id long, derived_tags array<string>, vocab_terms array<string>, metadata_date string, metadata_location string").write.parquet(f"{tmp_path}/file_contexts.parquet")
    q = entry.queries()
    assert {tuple(r) for r in q["transcript_windows"](spark, str(tmp_path)).collect()} == {(5, 0, "[00:00:01.5] one two last"), (6, 0, "(00:02) a 0:00:03 - b")}
    got = {r["file_id"]: r["transcript"] for r in q["file_records"](spark, str(tmp_path)).collect()}
    assert got == {5: "Ann: [00:00:01.5] one\ntwo\nlast", 6: "(00:02) a\n0:00:03 - b", 7: None}
