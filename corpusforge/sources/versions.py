"""Tables whose readers never see half a run.

A table lies in a fixed number of buckets by the hash of a key.  A run writes the buckets that it
changes anew, each in a folder of its own version beside the old one, and then puts a commit in
place: a small file that names the version of every bucket.  Commits are numbered; readers take
the greatest, or the one they are told.  A run that breaks off leaves folders that no commit names.
``clean`` deletes what the given commits don't name.

The driver handles one row for each bucket, whatever the number of keys.  Commits are put in place by
renaming a finished file, and only where there is none of that number, so the later of two runs that
began at the same commit fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class Conflict(Exception):
    """Another run has put a commit in place meanwhile."""


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, path: str) -> list[int]:
    where, store = _at(spark, path + "/_commits")
    if not store.exists(where):
        return []
    names = [f.getPath().getName() for f in store.listStatus(where)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def state(spark: SparkSession, path: str, number: int | None = None) -> dict | None:
    """What a commit says, the last one by default; None if there is none."""
    known = numbers(spark, path)
    if not known or number is not None and number not in known:
        return None
    where, store = _at(spark, f"{path}/_commits/{number or known[-1]:012d}.json")
    stream = store.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode()) | {"number": number or known[-1]}
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, facts: dict, after: int | None = None) -> int:
    """Puts the commit after ``after`` (by default the last one) in place; its number."""
    number = (max(numbers(spark, path), default=0) if after is None else after) + 1
    final, store = _at(spark, f"{path}/_commits/{number:012d}.json")
    draft, _ = _at(spark, f"{path}/_commits/.{uuid.uuid4().hex}")
    out = store.create(draft, False)
    out.write(bytearray(json.dumps(facts | {"number": number}).encode()))
    out.close()
    if store.exists(final) or not store.rename(draft, final):
        store.delete(draft, False)
        raise Conflict(f"{path} has a commit {number} already")
    return number


def bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def read(spark: SparkSession, path: str, number: int | None = None, only: Sequence[int] | None = None) -> DataFrame | None:
    """The rows of a commit; of these buckets alone, if given.  None if there is no commit."""
    now = state(spark, path, number)
    if now is None:
        return None
    schema = StructType.fromJson(now["schema"])
    folders = [f"{path}/bucket={b}/version={v}" for b, v in now["buckets"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def replace(spark: SparkSession, path: str, rows: DataFrame, gone: DataFrame | None = None, key: str = "page_id", order: Sequence[str] = (), buckets: int = BUCKETS) -> int:
    """The rows take the place of all that have one of their keys; rows with a key of ``gone`` (one column) go as well.

    rows are read twice, so they should come from a table.  The new commit's number; where nothing changes, the old one's."""
    now = state(spark, path)
    count = now["of"] if now else buckets
    keys = rows.select(F.col(key).cast("string").alias("changed")).distinct()
    if gone is not None:
        keys = keys.unionAll(gone.toDF("changed").select(F.col("changed").cast("string"))).distinct()
    touched = [r[0] for r in keys.select(F.pmod(F.xxhash64("changed"), F.lit(count)).cast("int")).distinct().collect()]  # at most as many as buckets
    if not touched and now:
        return now["number"]
    old = read(spark, path, only=touched) if now else None
    whole = rows
    if old is not None:
        whole = old.join(keys, F.col(key).cast("string").eqNullSafe(F.col("changed")), "left_anti").unionByName(rows, allowMissingColumns=True)
    version = uuid.uuid4().hex[:12]
    dealt = whole.withColumns({"bucket": bucket(key, count), "version": F.lit(version)}).hint("rebalance", "bucket")
    dealt.sortWithinPartitions("bucket", *(order or (key,))).write.mode("append").partitionBy("bucket", "version").parquet(path)
    there = [b for b in touched if _exists(spark, f"{path}/bucket={b}/version={version}")]
    kept = {b: v for b, v in (now["buckets"] if now else {}).items() if int(b) not in touched}
    return commit(spark, path, {"of": count, "schema": json.loads(whole.schema.json()), "buckets": kept | {str(b): version for b in there}}, now["number"] if now else 0)


def overwrite(spark: SparkSession, path: str, rows: DataFrame) -> int:
    """The rows take the place of the whole table, which is one bucket then; the new commit's number."""
    now, version = state(spark, path), uuid.uuid4().hex[:12]
    rows.write.parquet(f"{path}/bucket=0/version={version}")
    return commit(spark, path, {"of": 1, "schema": json.loads(rows.schema.json()), "buckets": {"0": version}}, now["number"] if now else 0)


def _exists(spark: SparkSession, path: str) -> bool:
    where, store = _at(spark, path)
    return store.exists(where)


def clean(spark: SparkSession, path: str, keep: Sequence[int] = ()) -> None:
    """Deletes versions and commits that are neither the last nor in ``keep``."""
    known = numbers(spark, path)
    held = {*known[-1:], *keep}
    named = {(b, v) for n in held & set(known) for b, v in state(spark, path, n).get("buckets", {}).items()}
    where, store = _at(spark, path)
    if not store.exists(where):
        return
    for part in store.listStatus(where):
        name = part.getPath().getName()
        if name.startswith("bucket="):
            versions = list(store.listStatus(part.getPath()))
            for one in versions:
                if (name[7:], one.getPath().getName().removeprefix("version=")) not in named:
                    store.delete(one.getPath(), True)
    for n in known:
        if n not in held:
            store.delete(_at(spark, f"{path}/_commits/{n:012d}.json")[0], False)
