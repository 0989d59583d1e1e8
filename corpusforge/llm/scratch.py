"""Tables written in the cluster's shared folder, to cut lineage and to be read more than once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, under this process's own temp
    folder in local mode, and under the warehouse on a cluster."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if not base and (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="corpusforge-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = "file://" + _own[0]
    return f"{base or conf.get('spark.sql.warehouse.dir')}/corpusforge-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table that every executor can reach."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() gave, when nothing will read them any more."""
    for table in tables:
        drop_folder(table.sparkSession, table.written_at)


def drop_folder(spark: SparkSession, name: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def numbered(docs: DataFrame, text: str) -> tuple[DataFrame, str]:
    """The rows under names that can't clash with anything or need quoting, and the new name of ``text``; ``toDF`` gives the old names back."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index(text)]


def lean(spark: SparkSession) -> None:
    """Arrow batches of a few MB where the session has Spark's own defaults: texts are long rows, and
    two batches are held on either side of the pipe.  The setting stays with the session; no result
    depends on it."""
    for name, default, own in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", None, str(4 << 20))):
        name = f"spark.sql.execution.arrow.{name}"
        have = spark.conf.get(name)
        if have == default or default is None and _bytes(have) > int(own):
            spark.conf.set(name, own)


def _bytes(size: str) -> int:
    digits = size.rstrip("bBkKmMgG")
    return int(digits or 0) << {"k": 10, "m": 20, "g": 30}.get(size[len(digits) :][:1].lower(), 0)
