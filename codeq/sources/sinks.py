"""Written results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeq.session import shared_folder


def write_findings(findings: DataFrame, path: str | None = None) -> str:
    """Findings as Parquet, one folder per severity; returns where."""
    path = path or shared_folder(findings.sparkSession, "findings")
    findings.write.partitionBy("severity").parquet(path)
    return path


def write_table(df: DataFrame, path: str | None = None, purpose: str = "table") -> str:
    path = path or shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return path


def read_back(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_json_documents(df: DataFrame, path: str) -> str:
    """Each row as one JSON document per line."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    return path
