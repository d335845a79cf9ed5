import json

from parcelforge.sources import files
from parcelforge.streaming import ocr
from pyspark.sql import functions as F


def test_json_forms(spark, tmp_path):
    schema = "k string, n int"
    (tmp_path / "a.jsonl").write_text('{"k":"x","n":1}\n{"k":"y","n":2}\nnot json\n{"k":"x","n":3}\n')
    got = sorted(tuple(r) for r in files.json_rows(spark, str(tmp_path / "a.jsonl"), schema, key="k").collect() if r.k)
    assert got == [("x", 3), ("y", 2)]
    (tmp_path / "b.json").write_text(json.dumps({"results": [{"k": "x", "n": 1}, {"k": "z", "n": None}]}, indent=1))
    assert sorted(tuple(r) for r in files.json_rows(spark, str(tmp_path / "b.json"), schema, lines=False).collect()) == [("x", 1), ("z", None)]
    (tmp_path / "c.json").write_text('[{"k":"q","n":7}]')
    assert [tuple(r) for r in files.json_rows(spark, str(tmp_path / "c.json"), schema, lines=False).collect()] == [("q", 7)]


def test_csv_forms(spark, tmp_path):
    (tmp_path / "a.csv").write_text("key,score\n012,1.5\n7,nan\n8,\n9,abc\n")
    got = {r.key: r.score for r in files.typed_csv(spark, str(tmp_path / "a.csv"), "key string, score string", numbers=["score"]).collect()}
    assert got == {"012": 1.5, "7": None, "8": None, "9": None}
    (tmp_path / "t.csv").write_text("id1,u,Mill Lane,500,900\nid2,u,Far Lane,99999,900\n")
    near = files.positional_csv(spark, str(tmp_path / "t.csv"), {0: "id", 2: "name", 3: "x", 4: "y"}, (0, 0, 1000, 1000), pad=10)
    assert [tuple(r) for r in near.collect()] == [("id1", "Mill Lane", 500.0, 900.0)]


def test_layer_reads_only_what_is_asked(spark, tmp_path):
    df = spark.createDataFrame([(1, b"\x01", 0.0, 0.0, 1.0, 1.0), (2, None, 0.0, 0.0, 1.0, 1.0), (3, b"\x01", 50.0, 50.0, 60.0, 60.0)], "id int, geom binary, minx double, miny double, maxx double, maxy double")
    df.write.parquet(str(tmp_path / "l"))
    got = files.layer(spark, str(tmp_path / "l"), ["id"], bbox=(0, 0, 1, 1))
    assert [r.id for r in got.collect()] == [1] and got.columns == ["id", "geom"]


def test_cases_pages_config_and_stages(spark, tmp_path):
    rows = files.case_rows(spark.createDataFrame([(" 7_1 ", None, "Mill Lane", "a\\b/F_1"), ("", "x", "y", "z")], "k string, a string, b string, p string"), "k", ["a", "b"], "p").collect()
    assert [(r.unique_key, r.base_key, r.address, r.prefix) for r in rows] == [("7_1", "7", "Mill Lane", "F_1")]
    pages = spark.createDataFrame([("F/p2.jpg", [("late", 0.9)]), ("F/p1.jpg", [("low", 0.1), ("first", 0.8), (" ", 0.9)]), ("G/p1.jpg", [])], "image_path string, results array<struct<text: string, confidence: double>>")
    assert {r.folder: (r.pages, r.texts) for r in files.ocr_pages(pages).collect()} == {"F": (2, ["first", "late"]), "G": (1, [])}
    assert files.resolved_config({"root": "/d", "sub": "{root}/x", "deep": {"f": ["{sub}/{unknown}"]}}, {"root": "/e"})["deep"] == {"f": ["/e/x/{unknown}"]}
    stage = files.write_stage(spark.createDataFrame([(1, "a")], "i int, s string"), str(tmp_path / "s"), "csv")
    assert stage["columns"] == [["i", "int"], ["s", "string"]] and spark.read.csv(str(tmp_path / "s"), header=True).count() == 1
    files.write_manifest(spark, str(tmp_path / "m"), [stage])
    assert json.loads(spark.read.text(str(tmp_path / "m")).first().value)[0]["format"] == "csv"


def test_stream_resumes(spark, tmp_path):
    schema = "ocr_id long, prefix string, high_text_count int, loaded_at timestamp"
    data, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    make = lambda rows: spark.createDataFrame(rows, "ocr_id long, prefix string, high_text_count int, t string").withColumn("loaded_at", F.to_timestamp("t")).drop("t").coalesce(1).write.mode("append").parquet(data)
    make([(1, "F", 2, "2024-01-01"), (2, "F", 3, "2024-01-02")])
    ocr.resume_into(ocr.page_stream(spark, data, schema), out, mark, ["ocr_id"]).awaitTermination()
    make([(3, "G", 1, "2024-01-03")])
    ocr.resume_into(ocr.page_stream(spark, data, schema), out, mark, ["ocr_id"]).awaitTermination()
    assert sorted(r.ocr_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    q = ocr.folder_windows(ocr.page_stream(spark, data, schema), "loaded_at", "prefix", "ocr_id").writeStream.format("memory").queryName("folders").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.prefix, r.rows) for r in spark.table("folders").collect()} == {("F", 1), ("G", 1)}
