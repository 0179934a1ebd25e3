"""Session helpers: cutting lineage safely and reading tables."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once a context, for workers that could not import it.

    The archive is code that Spark's file server sends out; no data goes through it.
    """
    sc = spark.sparkContext
    if getattr(sc, "_probity_shipped", None) is None:
        root = Path(__file__).resolve().parents[1]
        copy = Path(tempfile.mkdtemp(prefix="spark-probity-"))
        shutil.copytree(root, copy / "code" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
        sc._probity_shipped = shutil.make_archive(str(copy / root.name), "zip", copy / "code")
        sc.addPyFile(sc._probity_shipped)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the one the cluster names in spark.checkpoint.dir.

    Only on one machine, where neither that setting nor a directory of the context is there, a temporary
    folder is taken. Spark removes checkpoints that nothing refers to any more where
    spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="probity-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there; survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_image_id(col) -> F.Column:
    """An image id as written in the pair tables ('7', ' 7', '7.0', '7.mat', 'batch_01/7.mat') as BIGINT.

    Anything that does not end in one number with an optional '.mat' or '.0' gives null.
    """
    trimmed = F.regexp_replace(col, r"^\s+|\s+$", "")
    return F.regexp_extract(trimmed, r"^(?:.*/)?0*([0-9]{1,18})(?:\.mat|\.0+)?$", 1).try_cast("bigint")


def plain_id(col) -> F.Column:
    """A patient id or stem plainly written: upper case, no blanks or hyphens, numbers without leading zeros."""
    bare = F.upper(F.regexp_replace(col, r"[\s\-]", ""))
    stripped = F.regexp_replace(bare, r"^0+(?=[0-9])", "")
    return F.nullif(F.when(bare.rlike(r"^[0-9]+$"), stripped).otherwise(bare), F.lit(""))


def plain_stem(stem, patient_id) -> F.Column:
    """The stem, or the patient id where it is null, plainly written; MR, six digits and one letter loses the letter."""
    chosen = F.coalesce(plain_id(stem), plain_id(patient_id))
    return F.regexp_replace(chosen, r"^(MR[0-9]{6})[A-Z]$", "$1")
