"""WARC archives with a two-level capture index.

``write`` stores one record for each row, gzipped by itself, in files that rotate by size.  Of rows
with equal payloads one is a response; the others are revisit records that name it and hold no
payload.  Each task writes its own files and returns where each record lies; those rows, written as
a table, say what belongs to the archive, so files of a task that failed are never read.

The index has a line for each record, by its url with the host reversed (``com,example)/path``) and
its record id.  Lines are dealt by range, sorted, and packed into gzipped blocks of ``LINES`` lines;
each index file has a sparse directory beside it, with the first and last key and the range of each
block, and a table has the first and last key of each file.  ``lookup`` finds the file by binary search
among the files' keys (a table of at most ``MAX_FILES`` rows), the blocks by binary search in the
file's directory, reads these ranges, and finds the lines by binary search in the block.  ``read``
takes the records' ranges from the archives, neighbours in one go.  A url with many captures has many
blocks, and these are dealt to many tasks; a revisit's response is looked up once for all that name it.

Files are opened by ``pyarrow.fs`` from the folder's uri, in tasks, so the folder must be one that all
executors reach.

Edges: a null payload is an empty one; a row without a url gets ``urn:page:`` and its key as url.  Keys of
more than ``LONGEST`` bytes end in a digest; white space and control characters in urls are escaped.
Rows that repeat key and payload are one capture stored twice: all of them are responses, or all
revisit the same one.  A null key comes last: such a row revisits one with a key, and is a response
where no equal payload has one.  Payloads are whole, whatever their length; equal ones are told by
SHA-256.  An empty table makes no files and no rows.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm.scratch import discard, drop_folder, folder, lean, written

#: Lines of a block, lines of an index file (more where there would be over MAX_FILES of them), bytes of an archive file.
LINES, FILE_LINES, MAX_FILES, FILE_BYTES = 500, 10_000, 4096, 256 << 20
#: Bytes of a key; a table of duplicated payloads up to this size goes to all tasks, a longer one is joined by shuffle.
LONGEST, BROADCAST_BYTES = 900, 32 << 20
#: Ranges that are at most GAP apart are read in one go of at most SPAN bytes, and dealt to tasks by stretches of SPAN.
GAP, SPAN = 64 << 10, 4 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "file string, offset long, length long, urlkey string, url string, record_id string, record_type string, digest string, refers_to string, refers_key string"


def url_key(url: Column) -> Column:
    """The url with its host's labels reversed, for sorting by domain; scheme and user left out."""
    clean = F.regexp_replace(url, r"[\x00-\x20\x7f]", "%20")
    rest = F.regexp_replace(clean, r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"(?s)^(?:[^/?#@]*@)?([^/?#:]*)", 1))
    tail = F.regexp_extract(rest, r"(?s)^(?:[^/?#@]*@)?[^/?#:]*(.*)$", 1)
    key = F.when(F.instr(clean, "://") > 0, F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail)).otherwise(clean)
    return F.when(F.octet_length(key) <= LONGEST, key).otherwise(F.concat(F.substring(key, 1, LONGEST // 5), F.lit("#"), F.sha2(key, 256)))


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/(?!//)", "file:///", folder))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(raw: bytes) -> bytes:
    """One gzip member."""
    press = zlib.compressobj(4, zlib.DEFLATED, 31)
    return press.compress(raw) + press.flush()


def record(kind: str, url: str, record_id: str, payload: bytes, digest: str, refers: tuple[str, str] | None, date: str, page: str | None) -> bytes:
    """A record: headers, HTTP headers and, in a response, the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, "WARC-Target-URI": quote(url, safe="%/:=&?~#+!$,;'@()*[]"), "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{base32_sha1(block)}"}
    if refers:
        head |= {"WARC-Profile": REVISIT, "WARC-Refers-To": f"<{refers[0]}>", "WARC-Refers-To-Target-URI": quote(refers[1], safe="%/:=&?~#+!$,;'@()*[]"), "WARC-Refers-To-Date": date}
    head["Content-Type"] = "application/http; msgtype=response"
    if page is not None:
        head["X-Page-Key"] = quote(page, safe="")
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of an unzipped record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("there is no record at this place")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
    return headers, block.partition(b"\r\n\r\n")[2]


class _Archives:
    """Archive files of one task, each begun with a warcinfo record."""

    def __init__(self, folder: str, file_bytes: int, date: str):
        self.store, self.base = _store(folder)
        self.most, self.date, self.out, self.at, self.name = file_bytes, date, None, 0, ""

    def add(self, raw: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= self.most:
            self.close()
            self.name, self.at = f"data/{uuid.uuid4().hex}.warc.gz", 0
            self.store.create_dir(f"{self.base}/data", recursive=True)
            self.out = self.store.open_output_stream(f"{self.base}/{self.name}", compression=None)
            note = b"software: corpusforge\r\nformat: WARC File Format 1.1\r\n"
            info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {self.date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(note)}\r\n\r\n"
            self._put(member(info.encode() + note + b"\r\n\r\n"))
        return self.name, self.at, self._put(member(raw))

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _roles(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with ``of``, the (key, url, name) of the response that has the same payload, where that is another; and the
    table of repeated payloads, to be dropped after use."""
    groups = rows.groupBy("same").agg(F.count("*").alias("n"), F.max(F.struct("key", "url", "name")).alias("of")).where("n > 1 and of.key is not null")
    groups = written(groups.select(F.col("same").alias("payload_of"), "of"))
    bytes_ = groups.agg(F.coalesce(F.sum(F.lit(200) + F.coalesce(F.octet_length("of.url"), F.lit(0)) + F.octet_length("of.name")), F.lit(0))).first()[0]
    met = rows.join(F.broadcast(groups) if bytes_ <= BROADCAST_BYTES else groups, F.col("same") == F.col("payload_of"), "left")
    return met.withColumn("of", F.when(F.col("key").eqNullSafe(F.col("of.key")), F.lit(None)).otherwise(F.col("of"))), groups


def _address(key: str, url: str) -> Column:
    return F.coalesce(F.nullif(F.col(url), F.lit("")), F.concat(F.lit("urn:page:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str = DATE, file_bytes: int = FILE_BYTES) -> None:
    """Archives and index of all rows in a new folder.  Payloads under ``min_bytes`` are always responses."""
    lean(pages.sparkSession)
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    where = _address(key, url)
    body = F.coalesce(F.col(payload), F.lit("")) if pages.schema[payload].dataType.simpleString() == "string" else F.coalesce(F.col(payload), F.lit(b""))
    body = body.cast("binary")
    same = F.when(F.octet_length(body) >= min_bytes, F.sha2(body, 256))
    rows = pages.select(F.col(key).alias("key"), name.alias("name"), where.alias("url"), url_key(where).alias("urlkey"), body.alias("payload"), same.alias("same"))
    rows, groups = _roles(rows)
    fields = [("url", "of.url"), ("name", "of.name")]
    rows = rows.select(F.col("key").isNotNull().alias("named"), "name", "url", "urlkey", "payload", *(F.col(c).alias(f"of_{k}") for k, c in fields), url_key(F.col("of.url")).alias("of_key"))
    identity = lambda n, digest: f"urn:page:{quote(n, safe='')}:{digest}"

    def run(batches):
        archives = _Archives(folder, file_bytes, date)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                digest = base32_sha1(row["payload"])
                own = identity(row["name"], digest)
                refers = (identity(row["of_name"], digest), row["of_url"]) if row["of_url"] is not None else None
                kind = "revisit" if refers else "response"
                raw = record(kind, row["url"], own, row["payload"], digest, refers, date, row["name"] if row["named"] else None)
                out.append((*archives.add(raw), row["urlkey"], row["url"], own, kind, digest, refers and refers[0], row["of_key"]))
            yield _batch(out, CAPTURES)
        archives.close()

    rows.mapInArrow(run, CAPTURES).write.parquet(f"{folder}/captures")
    discard(groups)
    _write_index(pages.sparkSession, folder)


def _batch(rows: list[tuple], kinds: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [pa.field(*(f.split()[0], types[f.split()[1]])) for f in kinds.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))


def _line(row: dict) -> bytes:
    rest = {k: row[k] for k in ("file", "offset", "length", "url", "record_type", "digest", "refers_to", "refers_key") if row[k] is not None}
    return f"{row['urlkey']} {row['record_id']} ".encode() + json.dumps(rest).encode() + b"\n"


def _write_index(spark: SparkSession, folder: str) -> None:
    rows = spark.read.schema(CAPTURES).parquet(f"{folder}/captures")
    files = max(1, min(MAX_FILES, -(-rows.count() // FILE_LINES)))

    def run(batches):
        store, base = _store(folder)
        name, out, at, lines, keys, blocks = f"index/{uuid.uuid4().hex}", None, 0, [], [], []

        def flush():
            nonlocal out, at
            if out is None:
                store.create_dir(f"{base}/index", recursive=True)
                out = store.open_output_stream(f"{base}/{name}.cdx.gz", compression=None)
            data = member(b"".join(lines))
            out.write(data)
            blocks.append({"first": keys[0], "last": keys[-1], "offset": at, "length": len(data)})
            at += len(data)
            lines.clear(), keys.clear()

        for batch in batches:
            for row in batch.to_pylist():
                lines.append(_line(row))
                keys.append(row["urlkey"])
                if len(lines) >= LINES:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            with store.open_output_stream(f"{base}/{name}.dir", compression=None) as sparse:
                sparse.write(json.dumps(blocks).encode())
            yield _batch([(name, blocks[0]["first"], blocks[-1]["last"], len(blocks))], "file string, first string, last string, blocks long")

    dealt = rows.repartitionByRange(files, "urlkey", "record_id").sortWithinPartitions("urlkey", "record_id")
    dealt.mapInArrow(run, "file string, first string, last string, blocks long").write.parquet(f"{folder}/directory")


def _spans(firsts: list[bytes], lasts: list[bytes], key: bytes) -> range:
    """Which of the sorted stretches may hold the key."""
    return range(bisect_left(lasts, key), bisect_right(firsts, key))


def lookup(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """The captures (as CAPTURES) of the url keys in the one column of ``keys``."""
    top = sorted((r.first.encode(), r.last.encode(), r.file) for r in spark.read.schema("file string, first string, last string, blocks long").parquet(f"{folder}/directory").select("first", "last", "file").collect())
    held = spark.sparkContext.broadcast(([t[0] for t in top], [t[1] for t in top], [t[2] for t in top]))  # MAX_FILES rows of at most 2 x LONGEST bytes

    def blocks(batches):
        store, base = _store(folder)
        firsts, lasts, names = held.value
        now, directory = None, ([], [], [])
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                for i in _spans(firsts, lasts, key.encode()):
                    if names[i] != now:
                        now = names[i]
                        with store.open_input_stream(f"{base}/{now}.dir", compression=None) as sparse:
                            entries = json.loads(sparse.read())
                        directory = [e["first"].encode() for e in entries], [e["last"].encode() for e in entries], entries
                    out += [(key, now, directory[2][b]["offset"], directory[2][b]["length"]) for b in _spans(*directory[:2], key.encode())]
            yield _batch(out, "key string, file string, offset long, length long")

    def lines(batches):
        store, base = _store(folder)
        now, rows, starts = None, [], []
        for batch in batches:
            out = []
            for key, file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, offset) != now:
                    now = file, offset
                    with store.open_input_file(f"{base}/{file}.cdx.gz") as packed:
                        rows = zlib.decompress(packed.read_at(length, offset), 31).split(b"\n")[:-1]
                    starts = [r.split(b" ", 1)[0] for r in rows]
                for i in range(bisect_left(starts, key.encode()), bisect_right(starts, key.encode())):
                    urlkey, own, rest = rows[i].decode().split(" ", 2)
                    entry = {"refers_to": None, "refers_key": None, "urlkey": urlkey, "record_id": own} | json.loads(rest)
                    out.append(tuple(entry[f.split()[0]] for f in CAPTURES.split(", ")))
            yield _batch(out, CAPTURES)

    asked = keys.toDF("key").where("key is not null").distinct()
    places = asked.repartitionByRange("key").sortWithinPartitions("key")
    found = places.mapInArrow(blocks, "key string, file string, offset long, length long")
    return found.repartition("file", "offset").sortWithinPartitions("file", "offset", "key").mapInArrow(lines, CAPTURES)


RECORD = "record_id string, page_key string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string"


def _together(places: Iterator[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Sorted (offset, length) pairs in runs that are read in one go."""
    run: list[tuple[int, int]] = []
    for offset, length in places:
        if run and (offset - sum(run[-1]) > GAP or offset + length - run[0][0] > SPAN):
            yield run
            run = []
        run.append((offset, length))
    if run:
        yield run


def read(captures: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records (as RECORD, with the payload if asked for) of these captures; what a revisit doesn't hold is null."""
    lean(captures.sparkSession)
    kinds = RECORD + ", payload binary" * payloads

    def run(batches):
        store, base = _store(folder)
        name, source = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            start = 0
            while start < len(rows):
                file, end = rows[start][0], start
                while end < len(rows) and rows[end][0] == file:
                    end += 1
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{base}/{file}")
                for stretch in _together((r[1], r[2]) for r in rows[start:end]):
                    first = stretch[0][0]
                    data = source.read_at(sum(stretch[-1]) - first, first)
                    yield _batch([_row(zlib.decompress(data[o - first : o - first + n], 31), payloads) for o, n in stretch], kinds)
                start = end
        if source is not None:
            source.close()

    places = captures.select("file", "offset", "length").repartition("file", F.floor(F.col("offset") / SPAN)).sortWithinPartitions("file", "offset")
    return places.mapInArrow(run, kinds)


def _row(raw: bytes, payloads: bool) -> tuple:
    head, payload = parsed(raw)
    whole = head["WARC-Type"] == "response"
    found = (len(payload), base32_sha1(payload)) if whole else (None, None)
    if whole and head["WARC-Payload-Digest"] != f"sha1:{found[1]}":
        raise ValueError(f"the payload of {head['WARC-Record-ID']} isn't what its digest says")
    refers = None if whole else head["WARC-Refers-To"][1:-1]
    return (head["WARC-Record-ID"][1:-1], head.get("X-Page-Key"), head["WARC-Target-URI"], head["WARC-Type"], refers, *found, *([payload if whole else None] * payloads))


def resolved(captures: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The same records with ``refers_page``, the page key of a revisit's response, and what that response holds in place of the
    nulls.  Responses are looked up in the index, each once."""
    rows = read(captures, folder, payloads)
    asked = captures.where("record_type = 'revisit'").select("refers_to", "refers_key").distinct()
    targets = lookup(captures.sparkSession, folder, asked.select("refers_key")).join(asked.select(F.col("refers_to").alias("record_id")), "record_id", "left_semi")
    held = ["page_key", "payload_bytes", "payload_digest", *["payload"] * payloads]
    # A response that is stored twice is one target.
    targets = read(targets, folder, payloads).groupBy(F.col("record_id").alias("target")).agg(*(F.first(c).alias(f"of_{c}") for c in held))
    both = rows.join(targets, F.col("refers_to") == F.col("target"), "left")
    return both.select("record_id", "page_key", "url", "record_type", "refers_to", F.col("of_page_key").alias("refers_page"), *(F.coalesce(c, f"of_{c}").alias(c) for c in held[1:]))


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", **settings) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to): every row written to archives, looked up by its url and read back."""
    spark = pages.sparkSession
    store = folder(spark)
    write(pages, store, key, url, payload, **settings)
    captures = written(lookup(spark, store, pages.select(url_key(_address(key, url)).alias("key"))))
    kind = pages.schema[key].dataType
    named = lambda c: F.url_decode(c).cast(kind)
    out = written(resolved(captures, store).select(named("page_key").alias(key), "payload_bytes", "payload_digest", "record_type", named("refers_page").alias("refers_to")))
    discard(captures)
    drop_folder(spark, store)
    return out


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) || '0' AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    ((strpos('0123456789abcdef', substr(h, i * 5 // 4 + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, i * 5 // 4 + 2, 1)) - 1) // (1 << CAST(3 - i * 5 % 4 AS INTEGER)) % 32 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM p
"""
