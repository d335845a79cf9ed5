"""Readers and writers of the file forms that stages exchange. Every reader gives a DataFrame with a pinned schema; nothing is inferred over the data."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.functions.text import base_key, first_filled, last_path_part, number


def layer(spark: SparkSession, path: str, columns: list[str], wkb: str = "geom", bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A vector layer stored as Parquet with its geometry as WKB and, for pruning, minx, miny, maxx, maxy columns where it has
    them: rows with a geometry that meet the bbox (edges included). Only the asked columns are read."""
    df = spark.read.parquet(path)
    df = df.where(F.col(wkb).isNotNull() & (F.length(wkb) > 0))
    if bbox and {"minx", "miny", "maxx", "maxy"} <= set(df.columns):
        df = df.where((F.col("minx") <= bbox[2]) & (F.col("maxx") >= bbox[0]) & (F.col("miny") <= bbox[3]) & (F.col("maxy") >= bbox[1]))
    return df.select(*columns, wkb)


def typed_csv(spark: SparkSession, path: str, schema: str, header: bool = True, numbers: list[str] = (), strict: bool = False) -> DataFrame:
    """CSV under a given schema; columns in `numbers` are read as text in the schema and become finite doubles or null.
    Damaged lines are dropped, or with strict fail the read."""
    df = spark.read.csv(path, schema=schema, header=header, mode="FAILFAST" if strict else "DROPMALFORMED", multiLine=False, escape='"')
    return df.withColumns({c: number(F.col(c)) for c in numbers})


def positional_csv(spark: SparkSession, path: str, positions: dict[int, str], bbox: tuple[float, float, float, float] | None = None, xy: tuple[str, str] = ("x", "y"), pad: float = 4000.0) -> DataFrame:
    """Headerless tiles: columns by position; unreadable files are skipped; x and y become numbers, kept within the padded bbox."""
    width = max(positions) + 1
    schema = ", ".join(f"_{i} string" for i in range(width))
    df = spark.read.option("ignoreCorruptFiles", "true").csv(path, schema=schema, header=False, mode="PERMISSIVE").select(*[F.col(f"_{i}").alias(n) for i, n in positions.items()])
    df = df.withColumns({c: number(F.col(c)) for c in xy})
    if bbox:
        df = df.where(F.col(xy[0]).between(bbox[0] - pad, bbox[2] + pad) & F.col(xy[1]).between(bbox[1] - pad, bbox[3] + pad))
    return df


def json_rows(spark: SparkSession, path: str, schema: str, lines: bool = True, key: str | None = None, holders: tuple[str, ...] = ("rows", "results")) -> DataFrame:
    """Rows of JSON lines, of one JSON list, or of an object that holds them under one of `holders`; damaged lines are dropped.
    With a key, of rows with the same key the last counts (files in order of their names, lines in order)."""
    text = spark.read.text(path, wholetext=not lines).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line"))
    one = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{_fields(schema)}>>"))
    held = F.from_json("value", ", ".join(f"{h} array<struct<{_fields(schema)}>>" for h in holders))
    single = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    rows = F.coalesce(one, *[held[h] for h in holders], F.when(F.ltrim("value").startswith("{"), F.array(single)))
    df = text.select("_file", "_line", F.posexplode(rows).alias("_at", "_row"))
    if key:
        rest = df.select("_row.*", "_file", "_line", "_at").groupBy(key).agg(F.max_by(F.struct("*"), F.struct("_file", "_line", "_at")).alias("_r"))
        return rest.select("_r.*").drop("_file", "_line", "_at")
    return df.select("_row.*")


def _fields(schema: str) -> str:
    return ", ".join(re.sub(r"^(\S+)\s+", r"\1: ", part.strip()) for part in re.split(r",(?![^<(]*[>)])", schema))


def case_rows(df: DataFrame, key: str, address: list[str], path: str | None = None) -> DataFrame:
    """(unique_key, base_key, address, prefix) of case rows with a key: the first filled address column, the last part of the path."""
    prefix = last_path_part(F.col(path)) if path else F.lit(None).cast("string")
    out = df.select(F.trim(F.col(key).cast("string")).alias("unique_key"), first_filled(*[F.col(f"`{c}`") for c in address]).alias("address"), prefix.alias("prefix"))
    return out.where(F.col("unique_key") != "").withColumn("base_key", base_key(F.col("unique_key")))


def ocr_pages(pages: DataFrame, least: float = 0.35) -> DataFrame:
    """(folder, pages, texts) per folder of pages (image_path, results array<struct<text, confidence, ..>>): texts at or above
    the confidence, in order of page and reading."""
    p = pages.select(F.regexp_extract("image_path", "^(.*?)/?[^/]*$", 1).alias("folder"), "image_path", "results")
    lines = p.select("folder", "image_path", F.posexplode_outer("results").alias("at", "r"))
    good = (F.col("r.confidence") >= least) & (F.trim("r.text") != "")
    return lines.groupBy("folder").agg(F.count_distinct("image_path").alias("pages"), F.transform(F.array_sort(F.collect_list(F.when(good, F.struct("image_path", "at", "r.text")))), lambda x: x["text"]).alias("texts"))


def resolved_config(raw: dict, overrides: dict | None = None, depth: int = 8) -> dict:
    """A configuration with `{name}` in texts replaced by its own entries, again and again until nothing changes; unknown names stay."""
    config = raw | (overrides or {})
    flat = {k: str(v) for k, v in config.items() if isinstance(v, str | int | float)}

    def fill(v):
        if isinstance(v, str):
            for _ in range(depth):
                new = re.sub(r"\{(\w+)\}", lambda m: flat.get(m[1], m[0]), v)
                if new == v:
                    break
                v = new
            return v
        if isinstance(v, dict):
            return {k: fill(x) for k, x in v.items()}
        return [fill(x) for x in v] if isinstance(v, list) else v

    return fill(config)


def write_stage(df: DataFrame, path: str, form: str = "parquet", partition_by: list[str] = (), order: list[Column] | None = None) -> dict:
    """Writes a stage's table (parquet, csv or json) and returns its manifest: path, form, columns."""
    w = (df.sortWithinPartitions(*order) if order else df).write.mode("overwrite")
    w = w.partitionBy(*partition_by) if partition_by else w
    (w.option("header", "true").csv(path) if form == "csv" else w.format(form).save(path))
    return {"path": path, "format": form, "columns": [list(c) for c in df.dtypes]}


def write_manifest(spark: SparkSession, path: str, stages: list[dict]) -> None:
    """The stages' manifests as one small JSON text beside them."""
    spark.createDataFrame([(json.dumps(stages, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
