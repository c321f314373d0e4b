"""Tables written to the shared folder of the cluster, to cut lineage and to be read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_local: list[str] = []  # the folder of a local session without the setting, which cannot be set later


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session without that setting gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise RuntimeError("spark.checkpoint.dir is not set; a cluster needs a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="framelore-"))
        folder = _local[0]
    return folder.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Hand texts to Python in batches of at most so many rows, so that a worker's memory does not hold thousands of long texts.

    A session setting, as Spark has no other place for it; a smaller value that is set already stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/framelore/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete what stored() wrote for df, once nothing that is still to be computed reads it."""
    path = getattr(df, "_stored_at", None)
    if path:
        context = df.sparkSession.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, key: str, name: str, rank: str = "rank") -> DataFrame:
    """Number the rows of each key from 0, densely, without bringing a key's rows together.

    Each partition counts its own rows; the counts of the partitions, summed in order, give every
    partition its first number. The numbers are written before they are used, so a task that runs
    again cannot change them.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def count(batches):
        from pyspark import TaskContext

        seen: dict = {}
        part = TaskContext.get().partitionId()
        for b in batches:
            first = b[key].map(lambda k: seen.get(k, 0)).astype("int64") if len(b) else b[key].astype("int64")
            b = b.assign(__part=part, __local=first + b.groupby(key).cumcount())
            for k, n in b[key].value_counts().items():
                seen[k] = seen.get(k, 0) + int(n)
            yield b

    rows = stored(df.mapInPandas(count, f"{fields}, __part int, __local long"), name)
    return with_global_rank(rows, key, "__part", "__local", rank).drop("__part", "__local")


def with_global_rank(rows: DataFrame, key: str, part: str, local: str, rank: str) -> DataFrame:
    """rank = local + the rows of the same key in earlier partitions."""
    from pyspark.sql import Window

    counts = rows.groupBy(part, key).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(part, key, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return rows.join(bases, [part, key]).withColumn(rank, F.col(local) + F.col("__base")).drop("__base")


def joined_hot(rows: DataFrame, table: DataFrame, key: str, count: str, most: int = 50_000) -> DataFrame:
    """rows left joined with table(key, count: how many rows have the key, ...), count dropped. The keys of at least 1000 rows, or of as many as
    let no more than `most` be so, go to every task with what the table says of them, so that no task gets all rows of one key."""
    total = table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    often = max(1000, total // most)
    hot = F.broadcast(table.where(F.col(count) >= often).drop(count))
    cold = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col(count) < often).drop(count), key, "left")
    return cold.unionByName(rows.join(hot, key).select(*cold.columns))
