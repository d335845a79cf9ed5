"""Scanned pages as they arrive: counts per folder, late pages included up to a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def page_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of pages in a folder, a bounded number of files in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def folder_windows(pages: DataFrame, at: str, folder: str, key: str, late: str = "30 days", every: str = "1 day") -> DataFrame:
    """(window, folder, rows, high_text): rows per folder and window of arrival. Repeated rows of a key count once, rows later
    than `late` behind the latest are left to the batch run; state is dropped behind the watermark, so it stays bounded."""
    once = pages.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    return once.groupBy(F.window(at, every), F.col(folder)).agg(F.count(F.lit(1)).alias("rows"), F.sum("high_text_count").alias("high_text"))


def resume_into(stream: DataFrame, table_path: str, checkpoint: str, keys: list[str]):
    """Starts a run that takes what is there and ends; a later run goes on where this one stopped. Each batch's rows are
    written under its number, so a batch that is run again after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
