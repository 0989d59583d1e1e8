"""Session defaults and table access."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "corpusforge", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster the master comes from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a folder; only Spark opens the path, so any store will do."""
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(spark: SparkSession) -> None:
    """Arrow batches of a few MB where the session has Spark's own defaults: texts and pages are long rows.  No result depends on it."""
    for name, default, own in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", str(256 << 20), str(4 << 20))):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name).lower().rstrip("b") in (default, "256m"):
            spark.conf.set(name, own)


_own: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors share: under spark.checkpoint.dir; where that is unset, under
    this process's own temp folder in local mode, and under the warehouse on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base and (master == "local" or master.startswith("local[")):
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="corpusforge-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = "file://" + _own[0]
    return f"{base or spark.conf.get('spark.sql.warehouse.dir')}/corpusforge-{name}-{spark.sparkContext.applicationId}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: for small results that several branches of a plan read."""
    path = shared_folder(rows.sparkSession, f"{name}-{uuid.uuid4().hex}")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files at a path: another one whenever the table there was written anew."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    digest, files = hashlib.sha256(), store.listFiles(where, True)
    while files.hasNext():
        f = files.next()
        digest.update(f"{f.getPath().toUri()} {f.getLen()} {f.getModificationTime()}\n".encode())
    return digest.hexdigest()
