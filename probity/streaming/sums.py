"""Streams, as an extension: the additive sums of an evaluation kept up to date while rows arrive.

All metrics come from sums (operators.metrics), so a batch's sums are added to the sums so far and any metric
of the whole is exact at any time. Event counts in time windows use a watermark for late rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as m
from ..sources.files import scratch


def arriving(spark, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern holds for a folder and for one file


def run_to_end(stream: DataFrame, fold, mode: str, name: str) -> None:
    """Process all that is there, batch by batch, and stop."""
    query = stream.writeStream.outputMode(mode).foreachBatch(fold).option("checkpointLocation", scratch(stream.sparkSession, name)).trigger(availableNow=True).start()
    query.awaitTermination()


def confusion_over_time(records: DataFrame, out: str) -> None:
    """Write each batch's confusion sums by (model, arm) below out; their sum is the confusion of all rows so far."""
    def fold(batch: DataFrame, number: int) -> None:
        m.cells(batch, ["model", "arm"]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    run_to_end(records, fold, "append", "confusion")


def q_stream_windows(spark, d):
    """Events and their mean value in hourly windows by type, with a watermark of two hours."""
    out = scratch(spark, "windows")
    windows = arriving(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 hours").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    # update mode: a batch gives the windows that it changed, and windows older than the watermark leave the state
    run_to_end(windows, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"), "update", "hourly")
    last = spark.read.parquet(out).groupBy("window", "event_type").agg(F.max_by(F.struct("n", "mean_value"), "batch").alias("x")).select("window", "event_type", "x.*")
    done = last.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "mean_value")
    return m.rounded(done, "mean_value")


def q_stream_confusion(spark, d):
    """Accuracy by model and arm from the confusion sums of the record files as they arrive."""
    out = scratch(spark, "sums")
    raw = arriving(spark, d, "retrain_files").select(F.try_parse_json("record").alias("v"))
    rows = raw.select(F.try_variant_get("v", "$.model", "string").alias("model"), F.try_variant_get("v", "$.arm", "string").alias("arm"), F.try_variant_get("v", "$.true_class", "int").alias("true_class"),
                      F.try_variant_get("v", "$.pred_class", "int").alias("pred_class")).where("model is not null and true_class is not null and pred_class is not null")
    confusion_over_time(rows, out)
    total = spark.read.parquet(out).groupBy("model", "arm").agg(*(F.sum(c).alias(c) for c in m.CELLS))
    n = sum((F.col(c) for c in m.CELLS), F.lit(0.0))
    return m.rounded(m.from_cells(total).select("model", "arm", n.cast("bigint").alias("n"), "accuracy", "balanced_accuracy"), "accuracy", "balanced_accuracy")


def queries() -> dict:
    return {"stream_windows": q_stream_windows, "stream_confusion": q_stream_confusion}


def oracle_sql() -> dict[str, str]:
    valid = "CASE WHEN json_valid(record) THEN record ELSE '{}' END"
    return {
        "stream_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(avg(value), 6) + 0.0::DOUBLE AS mean_value FROM events GROUP BY ALL",
        "stream_confusion": f"""WITH x AS (SELECT json_extract_string({valid}, '$.model') AS model, json_extract_string({valid}, '$.arm') AS arm, try_cast(json_extract_string({valid}, '$.true_class') AS INT) AS true_class, try_cast(json_extract_string({valid}, '$.pred_class') AS INT) AS pred_class FROM retrain_files),
y AS (SELECT * FROM x WHERE model IS NOT NULL AND true_class IS NOT NULL AND pred_class IS NOT NULL), c AS ({m.cells_sql('y', 'model, arm')}), k AS (SELECT model, arm, count(*) AS n FROM y GROUP BY ALL)
SELECT model, arm, n, {m._rd(m.ACC_SQL, 'accuracy')}, {m._rd(m.BA_SQL, 'balanced_accuracy')} FROM c JOIN k USING (model, arm)""",
    }
