"""Training artefacts: a folder each, with a manifest (JSON) and the leading rows of the
search (CSV), and the windows that are evaluated with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import schemas
from gridloom.sources import sinks

MANIFEST, TOP = "manifest.json", "top.csv"

#: The paths of a manifest's facts; where there are several, the first one
#: that is there counts.
PATHS = {
    "schema_version": ("schema_version",),
    "optimizer_sha": ("optimizer_sha",),
    "upstream_sha": ("upstream_sha",),
    "mode": ("selection_provenance.mode",),
    "training_start": ("training.start", "execution.start"),
    "training_end": ("training.end", "execution.end"),
    "execution_start": ("execution.start",),
    "execution_end": ("execution.end",),
    "selected_start": ("selection_provenance.training_start",),
    "selected_end": ("selection_provenance.training_end",),
    "top_sha256": ("selection_provenance.top_100_sha256",),
    "initial_cash": ("execution.initial_cash",),
    "fee_bps": ("execution.fee_bps_per_side",),
    "slippage_bps": ("execution.slippage_bps_per_side",),
    "odd_lot_extra_bps": ("execution.odd_lot_extra_bps_weighted",),
}
SOURCES = "optimizer_source_sha256"
MONEY = ("initial_cash", "fee_bps", "slippage_bps", "odd_lot_extra_bps")


def windows(spark: SparkSession, path: str) -> DataFrame:
    """The windows of a JSON file with a ``windows`` list, and their place in it."""
    found = spark.read.schema(f"windows array<struct<{schemas.WINDOW.replace(' string', ':string')}>>").json(path, multiLine=True)
    return found.select(F.posexplode("windows").alias("place", "w")).select("place", "w.*")


def _folder(file: str) -> Column:
    """The folder of a file, or of a table of that name in part files."""
    return F.regexp_extract(F.input_file_name(), rf"([^/]+)/{file.replace('.', chr(92) + '.')}(?:/[^/]*)?$", 1)


def manifests(spark: SparkSession, folders: str) -> DataFrame:
    """(artefact, manifest): the manifests' text by the name of their folder."""
    rows = spark.read.text(f"{folders}/{MANIFEST}", wholetext=True)
    return rows.select(_folder(MANIFEST).alias("artefact"), F.col("value").alias("manifest"))


def tops(spark: SparkSession, folders: str) -> DataFrame:
    """The leading rows of all artefacts, with the artefact's name."""
    return sinks.read_results(spark, f"{folders}/{TOP}").withColumn("artefact", _folder(TOP))


def top_hashes(spark: SparkSession, folders: str) -> DataFrame:
    """(artefact, sha256) of the files with the leading rows."""
    files = sinks.file_hashes(spark, f"{folders}/{TOP}")
    name = F.regexp_extract("path", r"([^/]+)/top\.csv(?:/[^/]*)?$", 1)
    return sinks.table_hashes(files.select(name.alias("name"), "sha256")).withColumnRenamed("name", "artefact")


def facts(found: DataFrame) -> DataFrame:
    """What a manifest tells, a column each: the fields of ``PATHS``, and ``sources``, a
    map of path to hash. What is absent, empty or of another kind is null, and so is all
    of a text that isn't JSON."""
    doc = F.try_parse_json("manifest")

    def at(path: str, kind: str = "string") -> Column:
        return F.try_variant_get(doc, f"$.{path}", kind)

    def first(name: str, paths: tuple[str, ...]) -> Column:
        if name in MONEY:
            return F.coalesce(*(at(p, "double") for p in paths)).alias(name)
        if name == "schema_version":
            return at(paths[0], "int").alias(name)
        return F.coalesce(*(F.nullif(at(p), F.lit("")) for p in paths)).alias(name)

    return found.select("artefact", *(first(k, p) for k, p in PATHS.items()), at(SOURCES, "map<string,string>").alias("sources"))
