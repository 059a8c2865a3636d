"""The final manifest of a run: a hash tree over its sources, written once, and the check
of files against it. Files are read by Spark, so they may lie on any file system."""

from __future__ import annotations

import platform

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources import sinks

SCHEMA_VERSION = 3
MODES = ("in_sample_full", "training_only")


def tracked(spark: SparkSession, root: str, patterns: list[str]) -> DataFrame:
    """(path, sha256) of the files under ``root`` that match the patterns (folders count
    with all that is below them), path relative to it. A pattern without a file fails."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().getPath().rstrip("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = reader.load([f"{root.rstrip('/')}/{p}" for p in patterns])
    place = F.regexp_replace(F.regexp_replace("path", r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", ""), r"/{2,}", "/")
    return found.select(F.substr(place, F.lit(len(base) + 2)).alias("path"), F.sha2("content", 256).alias("sha256"))


def tree(files: DataFrame) -> DataFrame:
    """(folder, files, sha256) of every folder down from the root (''): the hash of the
    sorted lines "name:sha256" of what lies in it, files and, with a slash behind their
    names, folders. Levels are hashed from the deepest up, so a folder only takes its own
    entries together."""
    parts = F.split("path", "/")
    own = files.select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("folder"), F.element_at(parts, -1).alias("name"), "sha256", F.lit(1).cast("long").alias("files"), (F.size(parts) - 1).alias("depth"))
    deepest = own.agg(F.max("depth")).first()[0]
    done, open_ = None, own
    for depth in range(deepest or 0, -1, -1):
        here = open_.where(F.col("depth") == depth)
        line = F.concat_ws(":", "name", "sha256")
        level = here.groupBy("folder").agg(F.sum("files").alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("sha256"))
        done = level if done is None else done.unionByName(level)
        up = F.split("folder", "/")
        higher = level.select(F.array_join(F.slice(up, 1, F.size(up) - 1), "/").alias("folder"), F.concat(F.element_at(up, -1), F.lit("/")).alias("name"), "sha256", "files", F.lit(depth - 1).alias("depth"))
        open_ = open_.where(F.col("depth") < depth).unionByName(higher)
    return done.select("folder", "files", "sha256")


def compare(files: DataFrame, listed: DataFrame) -> DataFrame:
    """(path, problem): files that are changed, missing or new against the listed hashes."""
    met = files.select("path", F.col("sha256").alias("is")).join(listed.select("path", F.col("sha256").alias("was")), "path", "full_outer")
    problem = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("is") != F.lower("was"), "changed")
    return met.select("path", problem.alias("problem")).where("problem is not null")


def finalise(spark: SparkSession, path: str, root: str, patterns: list[str], required: list[str], top: str, optimizer_sha: str, mode: str) -> dict:
    """Complete the manifest at ``path`` with the sources' hashes, the versions and what
    the selection was made on. It is written once: a manifest that already has its source
    identity fails, and so does a required source that isn't there."""
    if mode not in MODES:
        raise ValueError(f"{mode!r} is none of {MODES}")
    found = sinks.read_json(spark, path)
    if "source_identity" in found:
        raise ValueError(f"{path} is final already")
    files = tracked(spark, root, patterns).cache()
    try:
        hashes = {r["path"]: r["sha256"] for r in files.orderBy("path").collect()}  # source files of one repository
        if absent := sorted(set(required) - set(hashes)):
            raise ValueError(f"sources that must be there: {absent}")
        root_hash = tree(files).where("folder = ''").first()["sha256"]
    finally:
        files.unpersist()
    ran = found.get("execution") or {}
    leading = sinks.table_hashes(sinks.file_hashes(spark, top).select(F.lit("top").alias("name"), "sha256")).first()["sha256"]
    found |= {
        "schema_version": SCHEMA_VERSION,
        "optimizer_sha": optimizer_sha,
        "runtime": {"python": platform.python_version(), "pyspark": pyspark.__version__, "platform": platform.platform()},
        "source_identity": {"selection": patterns, "tracked_file_count": len(hashes), "tree_sha256": root_hash, "files_sha256": hashes},
        "optimizer_source_sha256": hashes,
        "selection_provenance": {"mode": mode, "training_start": ran.get("start"), "training_end": ran.get("end"), "top_100_sha256": leading},
    }
    sinks.write_json(spark, found, path)
    return found


def verify(spark: SparkSession, path: str, root: str, top: str | None = None) -> DataFrame:
    """(path, problem) of the sources, and of the leading rows, against a final manifest."""
    told = sinks.read_json(spark, path)
    identity = told.get("source_identity")
    if not identity:
        raise ValueError(f"{path} isn't final")
    listed = spark.createDataFrame([*identity["files_sha256"].items()], "path string, sha256 string")
    found = compare(tracked(spark, root, identity["selection"]), listed)
    if top:
        is_ = sinks.table_hashes(sinks.file_hashes(spark, top).select(F.lit(top).alias("name"), "sha256")).withColumnRenamed("name", "path")
        was = spark.createDataFrame([(top, told["selection_provenance"]["top_100_sha256"])], "path string, sha256 string")
        found = found.unionByName(compare(is_, was))
    return found
