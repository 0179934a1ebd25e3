"""Reading and writing the formats of the evaluation artefacts: CSV, gzip CSV, JSON lines, one-object JSON, Markdown.

Ids are text, whatever they look like, so CSV is read with a stated schema and never by inference. Spark's
commit protocol publishes a folder whole or not at all; a folder without _SUCCESS is not read.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.session import checkpoint_dir
from ..operators import metrics as m
from ..operators import splits as sp
from ..plans import fixtures as fx


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def with_text_ids(schema: StructType, ids: tuple[str, ...]) -> StructType:
    """The schema with the id columns as text."""
    return StructType([StructField(f.name, StringType() if f.name in ids else f.dataType, True) for f in schema])


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType, ids: tuple[str, ...] = ()) -> DataFrame:
    """CSV files, gzipped or not; a glob or folder is read as the union of its files."""
    return spark.read.schema(with_text_ids(schema, ids)).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | None = None, one_object: bool = False) -> DataFrame:
    """JSON lines, or files that hold one object each."""
    reader = spark.read.option("multiLine", one_object)
    return (reader.schema(schema) if schema else reader).json(path)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, stem, bytes, sha256 of the files below a folder; order_key puts numeric stems first, in numeric order."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return found.select("path", stem.alias("stem"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).withColumn(
        "order_key", F.struct(~F.col("stem").rlike(r"^[0-9]+$"), F.when(F.col("stem").rlike(r"^[0-9]{1,18}$"), F.col("stem").try_cast("bigint")), F.col("stem")))


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """line: the rows of a Markdown table."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |")).alias("line"))


def read_markdown(lines: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns of the table rows among lines; cells that do not fit a type become null."""
    cells = lines.where(F.col("line").rlike(r"^\| .* \|$") & ~F.col("line").rlike(r"^\|[ :\-|]+\|$")).select(F.split(F.regexp_replace("line", r"^\| | \|$", ""), re.escape(" | ")).alias("c")).where(F.size("c") == len(columns))
    return cells.select(*(F.nullif(F.get("c", F.lit(i)), F.lit("")).try_cast(t).alias(n) for i, (n, t) in enumerate(columns.items())))


# --- queries: written, read again, and compared by the SQL with what was written ---------------------------------------

def q_csv_roundtrip(spark, d):
    df, path = sp.images(spark, d).select("image_id", "patient_id", "label", "fold"), scratch(spark, "csv")
    write_csv(df, path, gzip=True)
    return read_csv(spark, path, df.schema, ("patient_id",))


def q_json_roundtrip(spark, d):
    df, path = m.q_point_metrics(spark, d).select("model", "arm", F.struct("accuracy", "macro_f1").alias("scores")), scratch(spark, "json")
    write_json(df, path)
    return read_json(spark, path, df.schema).select("model", "arm", "scores.accuracy", "scores.macro_f1")


def q_fold_files(spark, d):
    """Predictions of one model written as one folder a fold and read back as their union; the fold comes from the path."""
    path = scratch(spark, "folds")
    rows = fx.predictions(spark, d).where("model = 'm0'").select("arm", "unit_id", "true_class", "pred_class", "fold_a")
    rows.withColumnRenamed("fold_a", "fold").write.partitionBy("fold").option("header", True).csv(path)
    schema = rows.drop("fold_a").schema
    back = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path).withColumn("fold", F.regexp_extract(F.input_file_name(), "fold=([0-9]+)", 1).cast("int"))
    return back.groupBy("arm", "fold").agg(F.count("*").alias("n"), F.count_if(F.col("true_class") == F.col("pred_class")).alias("n_correct"))


def q_markdown_report(spark, d):
    """The metric table as Markdown lines, read back as a table."""
    cols = {"model": "string", "arm": "string", "accuracy": "double", "ece": "double"}
    path = scratch(spark, "report")
    markdown_rows(m.q_point_metrics(spark, d), list(cols)).write.text(path)
    return read_markdown(spark.read.text(path).withColumnRenamed("value", "line"), cols)


def q_file_listing(spark, d):
    """Predictions of one model written as one file a fold below folders, listed recursively in numeric order: place, name."""
    path = scratch(spark, "listing")
    rows = fx.predictions(spark, d).where("model = 'm0' and arm = 'A'").select(F.col("fold_a").cast("string").alias("fold"), "unit_id")
    rows.repartition(5, "fold").write.partitionBy("fold").option("header", True).csv(path)
    found = list_files(spark, path).where(F.col("path").endswith(".csv")).withColumn("fold", F.regexp_extract("path", "fold=([0-9]+)/", 1).cast("int"))
    back = spark.read.option("header", True).csv(path, recursiveFileLookup=True).select(F.regexp_extract(F.input_file_name(), "fold=([0-9]+)/", 1).cast("int").alias("fold"))
    return found.groupBy("fold").agg((F.count("*") > 0).alias("listed"), (F.min("bytes") > 0).alias("has_content"), (F.min(F.length("sha256")) == 64).alias("hashed")).join(back.groupBy("fold").agg(F.count("*").alias("n_rows")), "fold")


def picture_forms(df: DataFrame, row: str, pixels: str, side: int) -> DataFrame:
    """row, shape, md5 of the values as text, and the codes of the row's id written out again as text."""
    codes = F.transform(F.split(F.col(row).cast("string"), ""), lambda c: F.ascii(c))
    return df.select(row, F.concat_ws("x", F.expr(f"size({pixels}) div {side}"), F.lit(side)).alias("shape"), F.md5(F.array_join(F.transform(pixels, lambda v: v.cast("string")), ",")).alias("md5"), decode_codes(codes).alias("decoded"))


def decode_codes(codes) -> F.Column:
    """An array of character codes as text."""
    return F.array_join(F.transform(codes, lambda c: F.char(c)), "")


def q_picture_forms(spark, d):
    one = spark.read.parquet(f"{d}/image_manifest.parquet").where("thumb is not null and image_id is not null").groupBy("image_id").agg(F.max("thumb").alias("thumb"))
    return picture_forms(one, "image_id", "thumb", 10)


def queries() -> dict:
    return {"file_listing": q_file_listing, "picture_forms": q_picture_forms, "csv_roundtrip": q_csv_roundtrip, "json_roundtrip": q_json_roundtrip, "fold_files": q_fold_files, "markdown_report": q_markdown_report}


def oracle_sql() -> dict[str, str]:
    return {
        "file_listing": f"WITH {fx.UNIT_SQL} SELECT fold_a AS fold, true AS listed, true AS has_content, true AS hashed, count(*) AS n_rows FROM unit GROUP BY 1",
        "picture_forms": "SELECT image_id, (len(thumb) // 10) || 'x10' AS shape, md5(array_to_string(thumb, ',')) AS md5, image_id::VARCHAR AS decoded FROM (SELECT image_id, max(thumb) AS thumb FROM image_manifest WHERE thumb IS NOT NULL AND image_id IS NOT NULL GROUP BY 1)",
        "csv_roundtrip": f"WITH {sp.IMAGES_SQL} SELECT image_id, patient_id, label, fold FROM im",
        "json_roundtrip": f"SELECT model, arm, accuracy, macro_f1 FROM ({m.POINT_SQL})",
        "fold_files": f"{m.W} SELECT arm, fold_a AS fold, count(*) AS n, count(*) FILTER (true_class = pred_class) AS n_correct FROM pred WHERE model = 'm0' GROUP BY ALL",
        "markdown_report": f"SELECT model, arm, accuracy, ece FROM ({m.POINT_SQL})",
    }
