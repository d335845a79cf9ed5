from parcelforge.plans import text_queries as T


def test_road_phrases_of_all_widths(spark, tmp_path):
    spark.createDataFrame([(1, "Oakham Upper Mill Hollow Lane"), (2, "14 The Elm Road"), (3, None)], "row_id long, original_address string").write.parquet(f"{tmp_path}/geocoder_rows.parquet")
    got = {(r.row_id, r.phrase) for r in T.QUERIES["wide_road_phrases"](spark, str(tmp_path)).collect()}
    assert got == {(1, "HOLLOW LANE"), (1, "MILL HOLLOW LANE"), (1, "UPPER MILL HOLLOW LANE"), (1, "OAKHAM UPPER MILL HOLLOW LANE"), (2, "ELM ROAD")}


def test_every_grid_reference(spark, tmp_path):
    texts = [(1, "Grid reference 452576, 361750; see grid reference 525 617. grid reference 452577/361751"), (2, "grid reference only, 123 456"), (3, None), (4, "GRID REFERENCE 123/456")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in T.QUERIES["all_grid_references"](spark, str(tmp_path)).collect())
    assert got == [(1, 0, 452576.0, 361750.0), (1, 1, 452500.0, 361700.0), (1, 2, 452577.0, 361751.0), (4, 0, 412300.0, 345600.0)]
