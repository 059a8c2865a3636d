"""Result sinks, manifests and the indicator cache."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import schemas


def write_csv(rows: DataFrame, path: str, compression: str | None = None) -> None:
    """CSV with a header and floats of 12 decimals."""
    text = [F.format_string("%.12f", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes]
    writer = rows.select(*text).write.mode("overwrite").option("header", True)
    (writer.option("compression", compression) if compression else writer).csv(path)


def read_results(spark: SparkSession, pattern: str) -> DataFrame:
    """All shards' result files."""
    return spark.read.schema(schemas.RESULT).csv(pattern, header=True)


def empty_results(spark: SparkSession) -> DataFrame:
    """A result table of an empty shard: all columns, no row."""
    return spark.createDataFrame([], schemas.RESULT)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    put_bytes(spark, path, text.encode())


def put_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """Write a small file, whatever file system the path is of."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_json(spark: SparkSession, value: object, path: str) -> None:
    put_text(spark, path, json.dumps(value, indent=2, ensure_ascii=False, default=str) + "\n")


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def file_hashes(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.sha2("content", 256).alias("sha256"))


def table_hashes(files: DataFrame) -> DataFrame:
    """(name, sha256) of each name in ``files`` (name, sha256): a file's own SHA-256, or of
    a table in several part files the SHA-256 of theirs, sorted and joined by commas."""
    parts = files.groupBy("name").agg(F.array_sort(F.collect_list("sha256")).alias("parts"))
    return parts.select("name", F.when(F.size("parts") == 1, F.col("parts")[0]).otherwise(F.sha2(F.concat_ws(",", "parts"), 256)).alias("sha256"))


def markdown(title: str, rows: DataFrame, most: int = 100) -> str:
    """A table of at most ``most`` rows as a Markdown report."""
    found = rows.limit(most).collect()
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(v) for v in r) + " |" for r in found)]) + "\n"


CACHE_VERSION = 1


def write_cache(table: DataFrame, path: str, facts: dict) -> None:
    """An indicator table with the facts that it holds for (data hash, periods, dates)."""
    table.write.mode("overwrite").parquet(f"{path}/data")
    head = table.sparkSession.createDataFrame([(CACHE_VERSION, json.dumps(facts, sort_keys=True, default=str))], "version int, facts string")
    head.write.mode("overwrite").parquet(f"{path}/facts")


def read_cache(spark: SparkSession, path: str, facts: dict) -> DataFrame:
    """The cached table, if it was written by this version for the same facts."""
    row = spark.read.parquet(f"{path}/facts").first()
    if row["version"] != CACHE_VERSION or row["facts"] != json.dumps(facts, sort_keys=True, default=str):
        raise ValueError(f"the cache at {path} is of other data or another version")
    return spark.read.parquet(f"{path}/data")
