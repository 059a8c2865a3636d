"""Session settings and shared-storage helpers used by the text operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes per Arrow batch sent to Python. Texts can be long, so batches stay small.
ARROW_ROWS = 1000
ARROW_BYTES = 8 << 20
#: What the rows of a broadcast table may take in memory.
BROADCAST_BYTES = 64 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, which need not have it on their path."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for p in (root / "__init__.py", *sorted((root / "llm").glob("*.py"))):
                out.write(p, p.relative_to(root.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)


def tune(spark: SparkSession) -> None:
    """Ship the package, and keep Arrow batches so small that a Python worker holds few
    texts at once. Results are evaluated later, so the settings stay with the session;
    values that are smaller already are left alone."""
    ship(spark)
    # A union of bucketed tables may be read unbucketed after its exchange was left out.
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where it is set.

    Where it is not set a temporary folder is chosen once and stored as the session's
    checkpoint folder, but only in local mode: elsewhere executors would write to their
    own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared storage, whatever file system that is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks it held, because the
    table that later steps read is on shared storage.
    """
    return Scratch(df.sparkSession).keep(df, name, *partition_by)


class Scratch:
    """The intermediate tables of one call, on shared storage. ``drop`` deletes those
    whose readers have been written out themselves; what a lazy result still reads is
    left alone."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held, self.tables = spark, [], {}

    def keep(self, df: DataFrame, name: str, *partition_by: str, **options) -> DataFrame:
        path = fresh_path(self.spark, name)
        writer = df.write.options(**options)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((out, path))
        return out

    def bucketed(self, df: DataFrame, name: str, *keys: str) -> DataFrame:
        """The same, bucketed and sorted by ``keys``: joins on them read it in place."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        path, table = fresh_path(self.spark, name), f"gridloom_{name}_{uuid.uuid4().hex}"
        df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
        out = self.spark.table(table)
        self.held.append((out, path))
        self.tables[path] = table
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        for df, path in [x for x in self.held if any(x[0] is f for f in frames)]:
            if path in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(path)}")
            delete(self.spark, path)
            self.held = [x for x in self.held if x[1] != path]

    def close(self, *but: DataFrame | None) -> None:
        """Delete all tables but those given."""
        self.drop(*[df for df, _ in self.held if not any(df is x for x in but)])


def if_small(table: DataFrame) -> tuple[DataFrame, bool]:
    """``table``, of fixed-width columns and already written out, to be broadcast in a
    join if its counted rows stay within ``BROADCAST_BYTES``, and else to be merged; and
    whether it is small."""
    small = table.count() * (32 + 16 * len(table.columns)) <= BROADCAST_BYTES
    return (F.broadcast(table) if small else table.hint("merge")), small


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
