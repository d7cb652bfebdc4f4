"""Session helper, table reader and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "molframe") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables, by whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs on one machine."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        got = f"file://{tempfile.mkdtemp(prefix='molframe-')}"
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


#: Scratch tables of this driver, in the order in which they were written.
_tables: list[str] = []


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """Cuts lineage: writes df as parquet below the shared folder and reads it back, so a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _tables.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` gave, once nothing that is still to run reads them. Others are left alone."""
    for df in tables:
        path = df.__dict__.get("_scratch")
        if path in _tables:
            _tables.remove(path)
            _delete(df.sparkSession, path)


def scratch_tables() -> list[str]:
    """The scratch tables there are, for sweep."""
    return list(_tables)


def sweep(spark: SparkSession, before: list[str], *keep: DataFrame) -> None:
    """Deletes the scratch tables that came after `before`, but for those of `keep`."""
    kept = [*before, *[x.__dict__.get("_scratch") for x in keep]]
    for path in [x for x in _tables if x not in kept]:
        _tables.remove(path)
        _delete(spark, path)
