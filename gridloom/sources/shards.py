"""Result shards: a CSV each with a JSON sidecar that tells what it holds, and the audit
that reconciles files, rows and sidecars."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.config import Costs, Grid
from gridloom.sources import sinks

# The sidecar's version, its field names, and what all shards must share.
SIDECAR_VERSION = 2
PROVENANCE = ("github_run_id", "optimizer_sha", "github_repository", "snapshot_upstream_sha", "snapshot_universe_sha256", "snapshot_requested_end")
RANGES = ("signal_min", "signal_max", "momentum_min", "momentum_max", "vol_period")
MONEY = ("initial_cash", "fee_bps", "slippage_bps", "odd_lot_extra_bps")
SIDECAR = (
    "schema_version int, shard int, shards int, gap_values array<int>, " + ", ".join(f"{c} int" for c in RANGES) + ", rows long, start string, end string, "
    + ", ".join(f"{c} double" for c in MONEY) + ", portfolio_policy string, momentum_dtype string, csv_sha256 string, " + ", ".join(f"{c} string" for c in PROVENANCE)
)
CONTRACT = ("shards", *RANGES, "start", "end", *MONEY, "portfolio_policy", "momentum_dtype", *PROVENANCE)
#: Fixed value: the rules of the portfolio fold.
POLICY = "pine_v17_hold_same_target_no_residual_reinvestment"


def _number(path: Column) -> Column:
    """The shard's number in a file's path, which may be a part file of the shard."""
    return F.nullif(F.regexp_extract(path, r"shard_(\d+)\.(?:csv|json)(?:/[^/]*)?$", 1), F.lit("")).cast("int")


def hashes(spark: SparkSession, folder: str, name: str = "shard_*.csv") -> DataFrame:
    """(shard, csv_sha256) of each shard as ``sinks.table_hashes`` has it. shard is null
    for a file whose name has no number."""
    files = sinks.file_hashes(spark, f"{folder}/{name}").select(_number(F.col("path")).alias("name"), "sha256")
    return sinks.table_hashes(files).select(F.col("name").alias("shard"), F.col("sha256").alias("csv_sha256"))


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecars' fields, and in ``file_shard`` the number in the file's name."""
    rows = spark.read.schema(SIDECAR).json(f"{folder}/shard_*.json", multiLine=True)
    return rows.withColumn("file_shard", _number(F.input_file_name()))


def write_shard(results: DataFrame | None, folder: str, shard: int, shards: int, grid: Grid, gaps: tuple[int, ...], span: tuple[str, str], costs: Costs, provenance: dict[str, str], spark: SparkSession) -> dict:
    """Write a shard's rows (None: it has no gap, and an empty table is written) and its
    sidecar, whose row count and hash are read back from the file."""
    path = f"{folder}/shard_{shard}.csv"
    rows = sinks.empty_results(spark) if results is None else results.select(*[F.lit(shard).alias("shard") if c == "shard" else F.col(c) for c in sinks.empty_results(spark).columns])
    sinks.write_csv(rows, path)
    ends = lambda values: (min(values), max(values))
    ranges = dict(zip(RANGES, (*ends(grid.signals), *ends(grid.momenta), grid.vols[0]), strict=True))
    meta = {"schema_version": SIDECAR_VERSION, "shard": shard, "shards": shards, "gap_values": [*gaps] if results is not None else []} | ranges
    meta |= {"rows": sinks.read_results(spark, path).count(), "start": span[0], "end": span[1]} | {c: getattr(costs, c) for c in MONEY}
    meta |= {"portfolio_policy": POLICY, "momentum_dtype": "float64", "csv_sha256": hashes(spark, folder, f"shard_{shard}.csv").first()["csv_sha256"]}
    meta |= {c: str(provenance.get(c, "")) for c in PROVENANCE}
    sinks.put_text(spark, f"{folder}/shard_{shard}.json", json.dumps(meta, indent=2, ensure_ascii=False) + "\n")
    return meta


def audit(spark: SparkSession, folder: str, shards: int, costs: Costs, provenance: dict[str, str] | None = None) -> DataFrame:
    """(shard, problem): what keeps a set of shards from being used; no row if all is
    well. Files, sidecars and rows are reconciled in one plan, and an absent field fails
    the rules that need it. A null shard stands for the set."""
    if shards < 1:
        raise ValueError("shards must be 1 at least")
    ends = lambda c: (F.min(c).alias(f"least_{c}"), F.max(c).alias(f"most_{c}"))
    rows = sinks.read_results(spark, f"{folder}/shard_*.csv").withColumn("file_shard", _number(F.input_file_name()))
    stats = rows.groupBy("file_shard").agg(
        F.count("*").alias("csv_rows"), F.count_if(~F.col("shard").eqNullSafe(F.col("file_shard"))).alias("foreign"), F.array_sort(F.collect_set("gap_period")).alias("csv_gaps"),
        *ends("signal_period"), *ends("momentum_period"), *ends("vol_period"), *ends("start"), *ends("end"),
    )
    files = hashes(spark, folder).select(F.col("shard").alias("file_shard"), F.col("csv_sha256").alias("sha256"), F.lit(True).alias("csv"))
    meta = sidecars(spark, folder).withColumn("json", F.lit(True))
    wanted = spark.range(shards).select(F.col("id").cast("int").alias("file_shard"), F.lit(True).alias("wanted"))
    met = wanted.join(files, "file_shard", "full_outer").join(meta, "file_shard", "full_outer").join(stats, "file_shard", "left")
    count, gaps = F.coalesce("csv_rows", F.lit(0)), F.coalesce("csv_gaps", F.array().cast("array<int>"))
    width = lambda x: F.greatest(F.col(f"{x}_max") - F.col(f"{x}_min") + 1, F.lit(0))
    both = lambda c, low, high: F.col(f"least_{c}").eqNullSafe(low) & F.col(f"most_{c}").eqNullSafe(high)
    day = lambda c: F.col(c).cast("date").cast("string")
    same_day = lambda c: F.col(f"least_{c}").cast("string").eqNullSafe(day(c)) & F.col(f"most_{c}").cast("string").eqNullSafe(day(c))
    rules = {
        "schema_version": F.col("schema_version") == SIDECAR_VERSION,
        "shard": F.col("shard") == F.col("file_shard"),
        "shards": F.col("shards") == shards,
        "rows": F.col("rows") == count,
        "shard column": F.coalesce("foreign", F.lit(0)) == 0,
        "csv_sha256": F.lower("csv_sha256") == F.col("sha256"),
        "gap_values": F.array_sort("gap_values") == gaps,
        **{c: F.abs(F.col(c) - getattr(costs, c)) <= 1e-12 for c in MONEY},
        "rows of ranges": F.col("rows") == F.size("gap_values") * width("signal") * width("momentum"),
        "signal range": (count == 0) | both("signal_period", F.col("signal_min"), F.col("signal_max")),
        "momentum range": (count == 0) | both("momentum_period", F.col("momentum_min"), F.col("momentum_max")),
        "vol_period": (count == 0) | both("vol_period", F.col("vol_period"), F.col("vol_period")),
        "start": (count == 0) | same_day("start"),
        "end": (count == 0) | same_day("end"),
        "github_run_id": F.col("github_run_id").rlike("^[0-9]+$"),
        "optimizer_sha": F.lower("optimizer_sha").rlike("^[0-9a-f]{40}$"),
        "github_repository": F.col("github_repository") != "",
        "snapshot_upstream_sha": F.lower("snapshot_upstream_sha").rlike("^[0-9a-f]{40}$"),
        "snapshot_universe_sha256": F.lower("snapshot_universe_sha256").rlike("^[0-9a-f]{64}$"),
        "snapshot_requested_end": F.expr("try_cast(snapshot_requested_end AS date)").isNotNull(),
    }
    for c, value in (provenance or {}).items():
        if value:
            rules[f"expected {c}"] = F.lower(c) == value.lower()
    failed = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(k)) for k, rule in rules.items()]
    here = F.when(F.col("file_shard").isNull(), F.array(F.lit("file name"))).when(F.col("wanted").isNull(), F.array(F.lit("unknown shard")))
    here = here.when(F.col("csv").isNull(), F.array(F.lit("no table"))).when(F.col("json").isNull(), F.array(F.lit("no sidecar")))
    every = here.otherwise(F.filter(F.array(*failed), lambda x: x.isNotNull()))
    found = met.select(F.col("file_shard").alias("shard"), F.explode(every).alias("problem"))
    shared = F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in CONTRACT))
    differs = meta.agg(F.count_distinct(shared).alias("n")).where("n > 1").select(F.lit(None).cast("int").alias("shard"), F.lit("contract").alias("problem"))
    return found.unionByName(differs)
