"""State: versions, queues and runs as immutable snapshots in numbered folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def reconcile(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Manifest rows against what lies in the folder: ``state`` known, missing or unregistered."""
    both = manifest.withColumn("_m", F.lit(True)).join(present.select("version", F.lit(True).alias("_p")), "version", "full_outer")
    return both.withColumn("state", F.when(F.col("_p").isNull(), "missing").when(F.col("_m").isNull(), "unregistered").otherwise("known")).drop("_m", "_p")


def sanitize(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Manifest without versions whose files are gone; the last one is current."""
    kept = manifest.join(present.select("version").distinct(), "version", "left_semi")
    last = kept.agg(F.max("version").alias("version")).withColumn("current", F.lit(True))
    return kept.join(last, "version", "left").withColumn("current", F.coalesce("current", F.lit(False)))


def working_input(manifest: DataFrame, original: str) -> DataFrame:
    """The latest version's output, or the original."""
    last = manifest.agg(F.max_by("output", "version").alias("_o"))
    return last.select(F.coalesce("_o", F.lit(original)).alias("input"))


def step(manifest: DataFrame, current: int, move: str) -> DataFrame:
    """The version a pointer moves to: next, prev, or a number."""
    v = F.col("version")
    rows = {"next": manifest.where(v > current).agg(F.min("version")), "prev": manifest.where(v < current).agg(F.max("version"))}.get(move)
    return (rows if rows is not None else manifest.where(v == int(move)).select("version")).toDF("version")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows that are not in the new ones, and all new ones."""
    return old.join(new, key, "left_anti").unionByName(new, allowMissingColumns=True)


def publish(df: DataFrame, folder: str, version: int, manifest: DataFrame | None, source: str) -> DataFrame:
    """Write a version and return the manifest that has it (an upsert by version)."""
    output = f"{folder}/version={version}"
    df.write.mode("overwrite").parquet(output)
    spark = df.sparkSession
    row = spark.createDataFrame([(version, source, output)], "version int, source string, output string").withColumn("created_at", F.current_timestamp())
    return row if manifest is None else upsert(manifest, row, ["version"])


def read_version(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/version={version}")


def only_new(items: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Resume: items whose output does not exist yet."""
    return items.join(done, key, "left_anti")


def run_row(spark: SparkSession, run_id: str, started: float, ended: float, status: str) -> DataFrame:
    return spark.createDataFrame([(run_id, float(started), float(ended), float(ended - started), status)], "run_id string, started double, ended double, seconds double, status string")


def log_view(events: DataFrame, time: str, kind: str, starts: str, versions: str, n_starts: int = 5, n_versions: int = 20) -> DataFrame:
    """The last run starts and version events, in order of time."""
    a = events.where(F.col(kind) == starts).orderBy(F.desc(time)).limit(n_starts)
    b = events.where(F.col(kind) == versions).orderBy(F.desc(time)).limit(n_versions)
    return a.unionByName(b).orderBy(time)


def batch_status(df: DataFrame, ok: Column, key: list[str]) -> DataFrame:
    """Rows of a batch as applied, skipped or failed."""
    return df.withColumn("batch_status", F.when(F.col("error").isNotNull(), "failed").when(ok, "applied").otherwise("skipped")).groupBy(*key, "batch_status").agg(F.count("*").alias("n"))


def fix_and_compare(texts: DataFrame, correct, audit, key: list[str], count: str = "occurrences") -> DataFrame:
    """Audit, correct, audit again, compare: one plan, no process in between. ``correct`` and ``audit`` map frames to frames."""
    from folioscope.operators.aggregate import compare_runs

    return compare_runs(audit(texts), audit(correct(texts)), key, count)


def with_gates(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """The first gate of an ordered list that stops a row, as ``stopped_at``; null passes all."""
    out = F.lit(None).cast("string")
    for name, passed in reversed(steps):
        out = F.when(~F.coalesce(passed, F.lit(False)), name).otherwise(out)
    return df.withColumn("stopped_at", out)
