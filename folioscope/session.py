"""Session helpers shared by all layers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings of a session of our own; a session that is handed in is never changed.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", memory: str = "8g", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("folioscope")
    settings = DEFAULTS | {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(shuffle_partitions)} | conf
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent, on one machine (tests, a laptop), a folder of our own is made and kept for the
    session; on a cluster, where each machine would write to its own disk, its absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = spark.conf.get("folioscope.shared.dir", None)
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("folioscope.shared.dir", own)
    return own


def staged(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder as compressed Parquet and read it back.

    A stage survives the loss of executors, is read column by column, and gives the next plan exact sizes. Stages are
    deleted when the driver's JVM ends, since the frames read from them may be used until then.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "stages", uuid.uuid4().hex)
    df.write.option("compression", "zstd").parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A project table; the reader is lazy, so pruning and pushdown reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
