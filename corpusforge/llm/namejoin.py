"""Join of names within an edit distance, by positional q-gram prefixes.

Distance: the fewest insertions, deletions and substitutions of one code point and exchanges of
two adjacent ones, substrings edited again where that is shorter (unrestricted Damerau-Levenshtein).

An edit touches at most ``gram + 1`` q-grams of a name (an exchange does; others touch ``gram``), so
of two names within ``most`` edits each has at most ``most * (gram + 1)`` grams that the other
lacks; the rest stand in the same order, moved by the insertions and deletions before them.  In any
order of all grams the first ``together`` that both share are then among the first
``most * (gram + 1) + together`` of each.  The order is rare-first: grams are counted over both sides
in ``BUCKETS`` hash buckets, a fixed size that may go to every task (ties by the gram's hash and its
place).  Each name is posted under every ``together`` of its first grams, with their places and its
length; the shorter table is posted under every places and length that few enough edits can lead to.
So one equi-join carries the prefix, length, position and count filters: what meets shares that many
grams at fitting places.  Pairs that meet are compared in the task that finds them: shared ends are
taken off, and what then needs dynamic programming first passes the count filter over all grams.

Names with too few grams for that bypass it: names of about that length (``most`` more than the
longest of them) are posted under their length and what is left of them after up to ``most``
deletions, which two names within ``most`` edits share, and meet in the same join.

Only distinct names take part, so any number of rows with one name costs one comparison; a name's
rows are counted before anything is joined.  A gram that many distinct names share at one place is
one key of that join, which adaptive execution splits.  Nothing that grows with the input is sent to
the driver, to all tasks or through one task.

Edges: names are taken with A-Z lower-cased and white space (\\x20, \\x09-\\x0D) removed; null names and
those empty by then take no part.  Very long names are posted under as many grams as others.  A null
key counts as a row, but not for the least key or the sum of hashes.  Rows that repeat count each; of
the right side, rows that repeat key and name are one.  An empty side gives no rows.  Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.scratch import discard, written

BUCKETS = 1 << 15
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Names of up to so many code points are compared as rows of one matrix.
SHORT = 64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def form(name: Column) -> Column:
    """A name as it is compared; null if nothing is left of it."""
    return F.nullif(F.regexp_replace(F.translate(name, UPPER, LOWER), "[ \\t-\\r]", ""), F.lit(""))


def misspelt(key: Column, name: Column) -> Column:
    """Names whose key has an even crc32 (as decimal text), with two adjacent code points exchanged."""
    h, size = F.crc32(key.cast("string").cast("binary")), F.length(name)
    at = (h % F.greatest(size - 1, F.lit(1))).cast("int")
    changed = F.concat(F.substring(name, F.lit(1), at), F.substring(name, at + 2, F.lit(1)), F.substring(name, at + 1, F.lit(1)), F.substring(name, at + 3, size))
    return F.when((h % 2 == 0) & (size >= 2), changed).otherwise(name)


def _mix(*values: np.ndarray) -> np.ndarray:
    h = np.zeros(len(values[0]), np.uint64)
    for v in values:
        h = (h ^ v.astype(np.uint64)) * _ODD[0]
        h ^= h >> np.uint64(29)
        h *= _ODD[1]
        h ^= h >> np.uint64(32)
    return h


def _grams(names: list[str], q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all grams of the names: which name, which place, hash; and the names' lengths."""
    sizes = np.array([len(n) for n in names], np.int64)
    flat = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(names)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = np.flatnonzero(place + q <= sizes[owner])
    hashes = _mix(*(flat[inside + i] for i in range(q))) if len(inside) else np.zeros(0, np.uint64)
    return owner[inside], place[inside], hashes, sizes


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


def gram_counts(names: DataFrame, q: int) -> np.ndarray:
    """How often grams occur in the column ``form``, by hash bucket: of a fixed size."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(_bucket(_grams(batch.column(0).to_pylist(), q)[2]), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    counts = np.zeros(BUCKETS, np.int64)
    for bucket, n in names.select("form").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():  # BUCKETS rows at most
        counts[bucket] = n
    return counts


def _leftovers(name: str, most: int) -> set[str]:
    return {"".join(c for i, c in enumerate(name) if i not in gone) for k in range(most + 1) for gone in combinations(range(len(name)), k)}


def _shifts(most: int, together: int) -> list[tuple[int, ...]]:
    """How ``most`` edits can move that many places, in ascending order, and the length: a stretch between two places costs as
    many edits as it grows or shrinks."""
    all_ = product(range(-most, most + 1), repeat=together + 1)
    return [s for s in all_ if abs(s[0]) + sum(abs(b - a) for a, b in zip(s, s[1:])) <= most]


def _posted(names: DataFrame, held, q: int, most: int, together: int, around: bool) -> DataFrame:
    """(key, form): a row for each key a name is posted under; ``around``: for all places and lengths that edits lead to."""
    first = most * (q + 1) + together
    short = first + q - 2  # so long a name has fewer than ``first`` grams
    shifts = _shifts(most, together) if around else [(0,) * (together + 1)]
    lengths = range(-most, most + 1) if around else (0,)

    def run(batches):
        counts = held.value
        for batch in batches:
            names = batch.column(0).to_pylist()
            if not names:
                continue
            owner, place, hashes, sizes = _grams(names, q)
            order = np.lexsort((place, hashes, counts[_bucket(hashes)], owner))
            owner, place, hashes = owner[order], place[order], hashes[order]
            start = np.searchsorted(owner, np.arange(len(names)))
            chosen = (np.arange(len(owner)) - start[owner] < first) & (sizes[owner] > short)
            owner, place, hashes = (x[chosen].reshape(-1, first) for x in (owner, place, hashes))
            order = np.argsort(place, 1)
            place, hashes = np.take_along_axis(place, order, 1), np.take_along_axis(hashes, order, 1)
            own, long = owner[:, 0], sizes[owner[:, 0]]
            keys, whose = [], []
            for at in combinations(range(first), together):
                of = _mix(*(hashes[:, i] for i in at))
                for shift in shifts:
                    keys.append(_mix(of, *(place[:, i] + d for i, d in zip(at, shift)), long + shift[-1]))
                    whose.append(own)
            for i in np.flatnonzero(sizes <= short + most):
                left = {f"{len(names[i]) + n}:{rest}" for rest in _leftovers(names[i], most) for n in lengths}
                keys.append(np.array([int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for x in left], np.uint64))
                whose.append(np.full(len(left), i))
            out = np.concatenate(keys).view(np.int64), np.concatenate(whose)
            for i in range(0, len(out[0]), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(out[0][i : i + 20_000]), batch.column(0).take(pa.array(out[1][i : i + 20_000]))], ["key", "form"])

    return names.select("form").mapInArrow(run, "key long, form string")


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein, by dynamic programming over all prefixes."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, before, match = [far, i], rows[i], 0
        for j, y in enumerate(b, 1):
            since, at = last.get(y, 0), match
            if x == y:
                match = j
            swap = rows[since][at] + (i - since - 1) + 1 + (j - at - 1)
            row.append(min(before[j] + (x != y), before[j + 1] + 1, row[j] + 1, swap))
        rows.append(row)
        last[x] = i
    return rows[-1][-1]


def _matrices(names: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names' code points as rows, from the front and from the back."""
    wide = int(sizes.max(initial=1)) or 1
    of = lambda rows: np.array(rows, f"<U{wide}").view(np.uint32).reshape(len(rows), wide)
    return of(names), of([n[::-1] for n in names])


def _shared(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each row, up to ``most``."""
    wide = min(a.shape[1], b.shape[1])
    same = (a[:, :wide] == b[:, :wide]) & (np.arange(wide) < most[:, None])
    return np.where(same.all(1), wide, (~same).argmax(1))


def _end(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def distances(left: list[str], right: list[str], most: int, q: int) -> np.ndarray:
    """Of each pair its distance, -1 beyond ``most``."""
    n, m = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    p, s = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    short = (n <= SHORT) & (m <= SHORT)
    if (at := np.flatnonzero(short)).size:
        (a, back_a), (b, back_b) = (_matrices([side[i] for i in at], size[at]) for side, size in ((left, n), (right, m)))
        least = np.minimum(n[at], m[at])
        p[at] = _shared(a, b, least)
        s[at] = _shared(back_a, back_b, least - p[at])
    for i in np.flatnonzero(~short):
        p[i] = _end(left[i], right[i])
        s[i] = _end(left[i][p[i] :][::-1], right[i][p[i] :][::-1])
    n, m = n - p - s, m - p - s
    out = np.full(len(left), -1, np.int64)
    out[(n == 0) & (m == 0)] = 0
    if most >= 1:
        out[(n <= 1) & (m <= 1) & (n + m > 0)] = 1
        for i in np.flatnonzero((n == 2) & (m == 2)):
            if left[i][p[i] : p[i] + 2] == right[i][p[i] : p[i] + 2][::-1]:
                out[i] = 1
    if most > 1:
        for i in np.flatnonzero((out < 0) & (np.abs(n - m) <= most)):
            a, b = left[i], right[i]
            if _share_enough(a, b, most, q):
                d = distance(a[p[i] : p[i] + n[i]], b[p[i] : p[i] + m[i]])
                out[i] = d if d <= most else -1
    return out


def _share_enough(a: str, b: str, most: int, q: int) -> bool:
    """The count filter."""
    needed = max(len(a), len(b)) - q + 1 - most * (q + 1)
    if needed <= 0:
        return True
    grams = [Counter(x[i : i + q] for i in range(len(x) - q + 1)) for x in (a, b)]
    return (grams[0] & grams[1]).total() >= needed


def similar(left: DataFrame, right: DataFrame, most: int = 1, gram: int = 2, together: int = 3) -> DataFrame:
    """(left_form, right_form, distance): every pair within ``most`` edits, of two tables of distinct forms.  ``right`` should be the
    shorter one."""
    if most < 0 or gram < 1 or together < 1:
        raise ValueError("most must be at least 0, gram and together at least 1")
    held = left.sparkSession.sparkContext.broadcast(gram_counts(left.select("form").unionAll(right.select("form")), gram))
    posted = _posted(left, held, gram, most, together, False).withColumnRenamed("form", "left_form")
    around = _posted(right, held, gram, most, together, True).withColumnRenamed("form", "right_form")

    def run(batches):
        for batch in batches:
            found = distances(batch.column(0).to_pylist(), batch.column(1).to_pylist(), most, gram)
            at = pa.array(np.flatnonzero(found >= 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(found[found >= 0].astype(np.int32))], ["left_form", "right_form", "distance"])

    met = posted.join(around.hint("merge"), "key").select("left_form", "right_form")
    return met.mapInArrow(run, "left_form string, right_form string, distance int").distinct()


def matches(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_name: Column, right_name: Column, most: int = 1, gram: int = 2, together: int = 3) -> DataFrame:
    """For each key of the right side and each distance with a match: the left rows' number, least key and sum of crc32 of their
    decimal keys, as n, first, crc."""
    text = F.crc32(F.col(left_key).cast("string").cast("binary"))
    classes = left.select(form(left_name).alias("form"), F.col(left_key).alias("id"), text.alias("crc")).where("form is not null")
    classes = written(classes.groupBy("form").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.sum("crc").alias("crc")))
    members = written(right.select(form(right_name).alias("form"), F.col(right_key).alias(right_key)).where("form is not null").distinct())
    pairs = similar(classes, members.select("form").distinct(), most, gram, together)
    folds = F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("crc").alias("crc")
    by_form = pairs.join(classes.hint("merge"), pairs.left_form == classes.form).groupBy("right_form", "distance").agg(*folds)
    by_key = members.join(by_form.hint("merge"), members.form == by_form.right_form).groupBy(right_key, "distance").agg(*folds)
    out = written(by_key)
    discard(classes, members)
    return out


_CRC = "xor(list_reduce(list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))), lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256), 4294967295), 4294967295)"
_FORM = "nullif(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]', '', 'g'), '')"
ORACLE_SQL = f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS t),
c AS MATERIALIZED (SELECT {_FORM.format("name")} AS form, count(*) AS n, min(client_id) AS least_id, sum(h) AS h FROM (SELECT name, client_id, {_CRC.format("CAST(client_id AS VARCHAR)")} AS h FROM clients, crc) GROUP BY 1),
w AS (SELECT vendor_id, name, {_CRC.format("CAST(vendor_id AS VARCHAR)")} AS h, length(name) AS size FROM vendors, crc),
v AS MATERIALIZED (SELECT DISTINCT vendor_id, {_FORM.format("misspelt")} AS form FROM (
  SELECT vendor_id, CASE WHEN h % 2 = 0 AND size >= 2 THEN left(name, spot) || substr(name, spot + 2, 1) || substr(name, spot + 1, 1) || substr(name, spot + 3) ELSE name END AS misspelt
  FROM (SELECT *, CAST(h % greatest(size - 1, 1) AS BIGINT) AS spot FROM w))),
pairs AS (SELECT vendor_id, n, least_id, h, v.form AS a, c.form AS b, length(v.form) AS la, length(c.form) AS lb FROM v JOIN c ON abs(length(v.form) - length(c.form)) <= 1),
ends AS (SELECT *, len(list_filter(range(1, least(la, lb) + 1), lambda i: left(a, i) = left(b, i))) AS p, len(list_filter(range(1, least(la, lb) + 1), lambda i: right(a, i) = right(b, i))) AS s FROM pairs),
far AS (SELECT *, CASE WHEN a = b THEN 0 WHEN p + s >= greatest(la, lb) - 1 THEN 1
  WHEN la = lb AND p + s = la - 2 AND substr(a, p + 1, 1) = substr(b, p + 2, 1) AND substr(a, p + 2, 1) = substr(b, p + 1, 1) THEN 1 END AS distance FROM ends)
SELECT vendor_id, CAST(distance AS INTEGER) AS distance, CAST(sum(n) AS BIGINT) AS n_clients, min(least_id) AS first_client_id, CAST(sum(h) AS BIGINT) AS clients_crc
FROM far WHERE distance IS NOT NULL GROUP BY vendor_id, distance
"""
