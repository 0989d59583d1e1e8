"""Vector code compression: product codes whose Lloyd rounds move only what changed.

A vector's components become integers (``floor(scale * x)``) and are cut into ``parts`` equal
consecutive pieces; each piece is replaced by the number of the nearest of ``entries`` codebook
entries.  A round of Lloyd's algorithm normally sums all pieces anew.  Here the table of vectors
carries the assignment of the round before, and the driver keeps the running integer sums (a
fixed size: parts x entries x (width + 1)).  A round assigns, and only vectors with a changed
assignment are read again: they add themselves to the new entry and subtract themselves from the
old one, folded within each task before anything is shuffled.  All sums are integers, so the
running sums equal those taken anew, to the last bit, in whatever order tasks end.

Edges: vectors that are null, empty or hold null or non-finite components are left out, and so
are those whose length isn't that of the kept vector with the least key (ties: the least vector)
or isn't a multiple of ``parts``.  Components are held at the largest magnitude for which a
vector's squared distance fits a long (2**27 for 64 components, that is 131,072 in x).  The first
entries are the vectors of the ``entries`` least distinct keys, nulls last; of vectors that share a
key, the least one.  With fewer keys the codebooks are shorter; an entry that nothing chose stays as
it is.  Rows that repeat, and rows with a null key, are coded like any others.  An empty table
gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.scratch import discard, lean, written


@dataclass
class Codebooks:
    """books: (parts, entries, width) integers."""

    books: np.ndarray
    scale: int

    @property
    def limit(self) -> int:
        return _limit(self.books.shape[0] * self.books.shape[2])

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _limit(dim: int) -> int:
    return math.isqrt((2**63 - 1) // max(1, dim)) // 2


def integers(vec: Column, scale: int) -> Column:
    """A vector's components as whole numbers; null where the vector can't be coded."""
    usable = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (F.size(vec) > 0)
    return F.when(usable, F.transform(vec, lambda x: F.floor(x.cast("double") * scale)))


def _whole(vectors: DataFrame, key: str, vec: str, scale: int, *others: str) -> DataFrame:
    rows = vectors.select(F.col(key).alias("key"), *(F.col(c).alias(c) for c in others), integers(F.col(vec), scale).alias("x"))
    return rows.where("x is not null")


def _held(rows: DataFrame, dim: int) -> DataFrame:
    """Rows of that length, their components within the limit."""
    most = _limit(dim)
    kept = F.transform("x", lambda v: F.greatest(F.least(v, F.lit(most)), F.lit(-most)).cast("int"))
    return rows.where(F.size("x") == dim).withColumn("x", kept)


def nearest(pieces: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each piece (rows of int64): the nearest entry, the lowest of equally near ones, and the squared distance."""
    largest = int(max(np.abs(pieces).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * book.shape[1] * largest**2 < 1 << 53:  # whole numbers below 2**53 are exact in floating point
        x, c = pieces.astype(np.float64), book.astype(np.float64)
        far = (c * c).sum(1) - 2 * (x @ c.T)
        chosen = far.argmin(1)
        return chosen, (far[np.arange(len(x)), chosen] + (x * x).sum(1)).astype(np.int64)
    chosen, least = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
    for i in range(0, len(pieces), 64):
        far = ((pieces[i : i + 64, None, :] - book[None]) ** 2).sum(2)
        chosen[i : i + 64] = far.argmin(1)
        least[i : i + 64] = far.min(1)
    return chosen, least


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


def _lists(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(matrix.astype(np.int32).ravel()))


def _assigned(rows: DataFrame, books: np.ndarray, keep: list[str], distances: bool = False) -> DataFrame:
    """The rows' columns ``keep`` with code and error; or, between rounds, with code, the code before and whether they differ."""
    parts = len(books)
    between = [c for c in ("code",) if c in rows.columns and not distances]
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    fields += ", code array<int>" + (", error bigint" if distances else ", before array<int>, moved boolean")

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cut = _matrix(batch.column("x"), n).reshape(n, parts, -1)
            found = [nearest(cut[:, p], books[p]) for p in range(parts)]
            code = np.stack([f[0] for f in found], 1)
            if distances:
                extra = [pa.array(sum(f[1] for f in found), pa.int64())]
            elif between:
                before = _matrix(batch.column("code"), n)
                extra = [_lists(before), pa.array((code != before).any(1))]
            else:
                extra = [pa.nulls(n, pa.list_(pa.int32())), pa.array(np.ones(n, bool))]
            names = [*keep, "code"] + (["error"] if distances else ["before", "moved"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), _lists(code), *extra], names)

    return rows.select(*dict.fromkeys([*keep, "x", *between])).mapInArrow(run, fields)


def _changes(state: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(slot, value): what the rows that moved add to the running sums; a slot is one component of an entry, or its count."""
    parts, entries, width = shape

    def run(batches):
        sums = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cut = _matrix(batch.column("x"), n).reshape(n, parts, width)
            rows = np.concatenate([cut, np.ones((n, parts, 1), np.int64)], 2)
            code, old = _matrix(batch.column("code"), n), batch.column("before")
            known = old.is_valid().to_numpy(zero_copy_only=False)
            before = np.full((n, parts), -1)
            if known.any():
                before[known] = old.flatten().to_numpy(zero_copy_only=False).reshape(-1, parts)
            for p in range(parts):
                plus, minus = code[:, p] != before[:, p], (code[:, p] != before[:, p]) & known
                np.add.at(sums[p], code[plus, p], rows[plus, p])
                np.subtract.at(sums[p], before[minus, p], rows[minus, p])
        flat = sums.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at], pa.int64())], ["slot", "value"])

    moved = state.where("moved").select("x", "code", "before").mapInArrow(run, "slot long, value long")
    return moved.groupBy("slot").agg(F.sum("value").alias("value"))


def _start(rows: DataFrame, dim: int, parts: int, entries: int) -> np.ndarray:
    """The first codebooks: the vectors of the least keys."""
    ids = [r[0] for r in rows.select("key").distinct().orderBy(F.asc_nulls_last("key")).limit(entries).collect()]
    chosen = F.col("key").isin([i for i in ids if i is not None])
    if None in ids:
        chosen = F.coalesce(chosen, F.lit(False)) | F.col("key").isNull()
    first = rows.where(chosen).groupBy("key").agg(F.min("x").alias("x")).collect()
    place = {k: i for i, k in enumerate(ids)}
    matrix = np.array([r.x for r in sorted(first, key=lambda r: place[r.key])], np.int64).reshape(-1, parts, dim // parts)
    return matrix.transpose(1, 0, 2).copy()


def fit(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, keep: tuple[str, ...] = ()) -> tuple[Codebooks, DataFrame]:
    """The codebooks after ``rounds`` rounds, and the table (key, x, keep) that they were made from."""
    lean(vectors.sparkSession)
    if not 0 < entries <= 256:
        raise ValueError("a code has room for 1 to 256 entries")
    rows = _whole(vectors, key, vec, scale, *keep).where(F.size("x") % parts == 0)
    first = rows.orderBy(F.asc_nulls_last("key"), "x").select(F.size("x")).first()
    dim = first[0] if first else parts
    state = written(_held(rows, dim))
    books = _start(state, dim, parts, entries)
    shape = (parts, books.shape[1], dim // parts)
    sums = np.zeros((*shape[:2], shape[2] + 1), np.int64)
    columns = ["key", *keep, "x"]
    for _ in range(rounds if first else 0):
        before, state = state, written(_assigned(state, books, columns))
        discard(before)
        for slot, value in _changes(state, shape).collect():  # parts x entries x (width + 1) at most
            sums.reshape(-1)[slot] += value
        counts = sums[:, :, -1:]
        books = np.where(counts > 0, sums[:, :, :-1] // np.maximum(counts, 1), books)
    return Codebooks(books, scale), state


def encode(vectors: DataFrame, fitted: Codebooks, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(key, code, error) of any vectors of the codebooks' length."""
    parts, entries, width = fitted.books.shape
    rows = _held(_whole(vectors, key, vec, fitted.scale), parts * width)
    return _assigned(rows if entries else rows.limit(0), fitted.books, ["key"], distances=True).withColumnRenamed("key", key)


def decode(code: Column, fitted: Codebooks) -> Column:
    """The vector that a code stands for: its entries' components by the scale, each at the middle of its step."""
    books = F.array(*(F.array(*(F.array(*(F.lit((v + 0.5) / fitted.scale) for v in entry)) for entry in book)) for book in fitted.books.tolist()))
    return F.flatten(F.zip_with(code, books, lambda c, book: F.get(book, c)))


def codes(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label", **settings) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256): two hex digits for each part; squared distances of each vector, and
    summed over the vectors of its label (nulls are one label).  A label's sum is held at the largest long."""
    fitted, state = fit(vectors.withColumn("label_", F.col(label)), key, vec, keep=("label_",), **settings)
    if not fitted.books.size:
        kind = vectors.schema[key].dataType.simpleString()
        discard(state)
        return vectors.sparkSession.createDataFrame([], f"{key} {kind}, code string, error long, label_error long, codebooks_sha256 string")
    rows = written(_assigned(state, fitted.books, ["key", "label_"], distances=True))
    discard(state)
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    sums = rows.groupBy(F.col("label_").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")), most).cast("long").alias("label_error"))
    text = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    both = rows.join(sums, F.col("label_").eqNullSafe(F.col("of")))
    return both.select(F.col("key").alias(key), text.alias("code"), "error", "label_error", F.lit(fitted.digest()).alias("codebooks_sha256"))


def _sql(parts: int = 4, width: int = 16, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    steps = [f"""
v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale}.0 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, x[part * {width} + 1 : (part + 1) * {width}] AS x FROM v, range({parts}) AS r(part)),
c0 AS MATERIALIZED (SELECT part, entry, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v) USING (vec_id) WHERE entry < {entries})"""]  # fmt: skip
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, label, part, best % {entries} AS entry, best // {entries} AS far FROM (
  SELECT vec_id, label, p.part, min(CAST(list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x) AS BIGINT) * {entries} + c.entry) AS best
  FROM p JOIN c{r} c ON c.part = p.part GROUP BY ALL))""")  # fmt: skip
        if r < rounds:
            steps.append(f"""
m{r} AS MATERIALIZED (SELECT part, entry, list(floor(s / n) ORDER BY i) AS x FROM (
  SELECT part, entry, i, sum(p.x[i]) AS s, count(*) AS n FROM p JOIN a{r} USING (vec_id, part), range(1, {width + 1}) AS t(i) GROUP BY ALL) GROUP BY part, entry),
c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (part, entry))""")  # fmt: skip
    return f"""WITH {','.join(steps)},
book AS (SELECT sha256(string_agg(CAST(CAST(x[i] AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM c{rounds}, range(1, {width + 1}) AS t(i)),
e AS (SELECT vec_id, label, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e, book"""


ORACLE_SQL = _sql()
