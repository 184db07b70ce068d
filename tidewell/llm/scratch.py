"""Tables and files written to the folder that all executors share.

The folder is ``spark.checkpoint.dir`` of the session. Where it is unset a local session (tests) gets a temporary folder;
a cluster without it is an error, since files on one machine's disk are lost to the others.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def base_dir(spark: SparkSession) -> str:
    """The shared folder, as a URI or an absolute path."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tidewell-")
    return _LOCAL[app]


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows and 8 MB, whatever the length of texts: workers hold a few of them at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def new_dir(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{base_dir(spark)}/tidewell-{label}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` and read it back: lineage is cut, and the rows outlive lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewell_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what ``keep`` wrote; for tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_tidewell_path", None)
        if path:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
