"""Pages over HTTP as a Spark data source, and the folder of page files as its sink.

``spark.read.format("corpus_pages")`` reads a page list that ``deal`` wrote: Parquet files (page_id,
source_url), each host in one file only.  A file is a partition, so a host is asked by one task at a time, at
most ``per_host`` times a second, while hosts are asked side by side.  Filters on page_id (equality, IN) are
pushed: other pages aren't asked for.  A page gets up to ``attempts`` requests; what went wrong with the last
one is in ``error``.

``df.write.format("corpus_pages")`` puts each page with html into ``<page_id>.html`` in a folder, by a whole file
that is then moved, so that a reader never has half a page and a task that runs again does no harm."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from corpusforge.session import shared_folder
from corpusforge.sources import http

SCHEMA = "page_id string, source_url string, html string, fetched_at timestamp, error string"
#: Page lists are dealt to so many files; rows of a batch that a task hands on.
FILES, TOGETHER = 64, 32


def _store(path: str) -> tuple[fs.FileSystem, str]:
    uri = path if re.match(r"^[a-z0-9]+:/", path) else "file://" + path
    return fs.FileSystem.from_uri(re.sub("^file:/(?!//)", "file:///", uri))


class ListPart(InputPartition):
    """One file of the page list."""


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.only = options["path"], None
        self.per_host, self.attempts, self.pause = float(options.get("per_host", "2")), int(options.get("attempts", "2")), float(options.get("pause", "1.5"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("page_id",):
                self.only = {f.value} if self.only is None else self.only & {f.value}
            elif isinstance(f, In) and f.attribute == ("page_id",):
                self.only = set(f.value) if self.only is None else self.only & set(f.value)
            else:
                yield f

    def partitions(self) -> list[ListPart]:
        store, base = _store(self.path)
        return [ListPart(i.path) for i in store.get_file_info(fs.FileSelector(base)) if i.path.endswith(".parquet")]

    def read(self, partition: ListPart) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        asked: dict[str, float] = {}

        def get(url: str) -> str:
            """Waits until the host may be asked again."""
            host = urlsplit(url).netloc
            wait = asked.get(host, 0) + 1 / self.per_host - time.monotonic()
            if wait > 0:
                time.sleep(wait)
            asked[host] = time.monotonic()
            return http.get(url)

        rows: list[tuple] = []
        with store.open_input_file(partition.value) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=1000):
                for page, url in zip(batch.column("page_id").to_pylist(), batch.column("source_url").to_pylist()):
                    if self.only is not None and page not in self.only:
                        continue
                    html, error = None, None
                    try:
                        html = http.attempt(lambda u=url: get(u), self.attempts, lambda n: self.pause * n)
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                    rows.append((page, url, html, datetime.now(timezone.utc), error))
                    if len(rows) >= TOGETHER:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in SCHEMA.split(", ")])


class PageSink(DataSourceWriter):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.path, self.page, self.html = options["path"], names.index("page_id"), names.index("html")

    def write(self, rows) -> WriterCommitMessage:
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        for row in rows:
            if row[self.html]:
                draft = f"{base}/.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(row[self.html].encode("utf-8", "replace"))
                store.move(draft, f"{base}/{row[self.page]}.html")
        return WriterCommitMessage()


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> PageSink:
        return PageSink(dict(self.options), schema.names)


def deal(pages: DataFrame, path: str) -> None:
    """Writes a page list (page_id, source_url) with each host in one file."""
    host = F.lower(F.regexp_extract("source_url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    pages.select("page_id", "source_url", host.alias("host")).repartition(FILES, "host").sortWithinPartitions("host", "page_id").select("page_id", "source_url").write.mode("overwrite").parquet(path)


def fetched(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """SCHEMA of the pages, asked for when it is read; options: per_host, attempts, pause."""
    path = shared_folder(spark, f"pages-{uuid.uuid4().hex}")
    deal(pages, path)
    spark.dataSource.register(PageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # without it Spark refuses a reader that takes filters
    return spark.read.format("corpus_pages").option("path", path).options(**{k: str(v) for k, v in options.items()}).load()


def save(pages: DataFrame, path: str) -> None:
    """Puts fetched pages into the folder that ``corpus.raw_pages`` reads."""
    pages.sparkSession.dataSource.register(PageSource)
    pages.select("page_id", "html").write.format("corpus_pages").option("path", path).mode("append").save()
