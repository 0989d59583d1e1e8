"""BM25 over a stored index of segments.

A segment has the documents of one run: a forward table (key, cell, length, terms with their counts), and
posting blocks.  A block holds the postings of one term in one cell, a set of about ``CELL`` documents
chosen by hash, with the documents' lengths and the greatest weight among them.  Blocks lie in folders by
term, sorted by term, so that a question reads the folders, and there the stretches, of its terms.

A search joins the blocks with the asked terms, deals them by cell, and scores cell by cell: a cell has
all postings of its documents, so scores are whole where they are made, and each task passes on the
best rows of each question only.  A task knows the k-th best score so far; a cell whose blocks' greatest
weights can't add up to it is skipped for that question.

A run that changes some documents writes one segment with their new versions, the keys that it buries in
older segments, and the terms that these lose; ``merge`` makes one segment of all.  Document frequencies
are sums over segments, number and lengths of the documents come with the commit, and so scores equal
those of an index that is made anew.  Commits are put in place last (``sources.versions``).

Null and empty texts count as documents without terms.  Keys should be unique.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions.text import tokenize
from corpusforge.operators.best import CELLS, Best
from corpusforge.session import delete_folder
from corpusforge.sources import versions

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Folders of blocks by term, documents of a cell, bytes of asked terms that go to every task at a time.
TERM_BUCKETS, CELL, BLOCK_BYTES = 32, 512, 32 << 20
#: Documents for each task of a search beyond one a core; multiplications that take as long as one posting that is added alone.
TASK, PRODUCT = 1 << 16, 400
#: More segments than these are merged by the next run.
MOST_SEGMENTS = 8


class IndexUnavailable(Exception):
    """There is no stored index."""


class IndexMismatch(Exception):
    """A stored index was made by another tokenizer, can't be read, or doesn't cover the corpus."""


@dataclass
class Bm25Index:
    """forward (segment, key, cell, dl, terms, tfs), blocks (segment, bucket, cell, term, bound, keys, tfs, dls), changes of document
    frequencies (bucket, term, df), buried (segment, cell, dead) or None; of the live documents: number, mean length, the mean of
    raw term weights; and the mean length that each segment's bounds were made with."""

    forward: DataFrame
    blocks: DataFrame
    frequencies: DataFrame
    buried: DataFrame | None
    documents: int
    average: float
    mean: float
    built: dict[str, float]

    @property
    def terms(self) -> DataFrame:
        """(bucket, term, df, idf): Okapi weights; a negative one is replaced by a share of the vocabulary's mean."""
        known = self.frequencies.groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df > 0")
        raw = _raw(F.col("df"), self.documents)
        return known.withColumn("idf", F.when(raw < 0, EPSILON * self.mean).otherwise(raw))

    @property
    def postings(self) -> DataFrame:
        """(bucket, term, key, tf) of the live documents."""
        rows = _live(self.blocks, self.buried).select("bucket", "term", F.explode(F.arrays_zip("keys", "tfs")).alias("p"), "dead")
        rows = rows.where(F.col("dead").isNull() | ~F.array_contains("dead", F.col("p.keys")))
        return rows.select("bucket", "term", F.col("p.keys").alias("key"), F.col("p.tfs").cast("long").alias("tf"))

    @property
    def lengths(self) -> DataFrame:
        """(key, dl) of the live documents."""
        return _alive(self.forward, self.buried).select("key", F.col("dl").cast("long").alias("dl"))


def _raw(df: Column, documents: int) -> Column:
    return F.log(F.lit(documents) - df + 0.5) - F.log(df + 0.5)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def _live(blocks: DataFrame, buried: DataFrame | None) -> DataFrame:
    """The blocks with the keys that are dead in their cell."""
    return blocks.withColumn("dead", F.lit(None).cast(blocks.schema["keys"].dataType)) if buried is None else blocks.join(buried, ["segment", "cell"], "left")


def _alive(forward: DataFrame, buried: DataFrame | None) -> DataFrame:
    if buried is None:
        return forward
    return forward.join(buried.select("segment", F.explode("dead").alias("key")), ["segment", "key"], "left_anti")


def forward(docs: DataFrame, key: str, text: str, cells: int) -> DataFrame:
    """(key, cell, dl, terms, tfs): the terms of each document once, in order, with their counts; one row stays one row."""
    cell = F.pmod(F.xxhash64(F.lit("cell"), F.col(key)), F.lit(cells)).cast("int")
    found = docs.select(F.col(key).alias("key"), cell.alias("cell"), tokenize(F.coalesce(F.col(text), F.lit(""))).alias("all"))
    return found.mapInArrow(_counted, f"key {docs.schema[key].dataType.simpleString()}, cell int, dl int, terms array<string>, tfs array<int>")


def _counted(batches):
    """Each row's tokens as its terms in order and their counts."""
    for batch in batches:
        lists = batch.column("all")
        size, code = lists.value_lengths().to_numpy(), lists.flatten().dictionary_encode()
        by_name = pc.array_sort_indices(code.dictionary).to_numpy()
        place = np.empty(len(by_name), np.int64)
        place[by_name] = np.arange(len(by_name))
        pairs, tf = np.unique(np.repeat(np.arange(len(size)), size) * max(1, len(by_name)) + place[code.indices.to_numpy()], return_counts=True)
        row, term = np.divmod(pairs, max(1, len(by_name)))
        offsets = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=len(size)))).astype(np.int32))
        terms = pa.ListArray.from_arrays(offsets, code.dictionary.take(pa.array(by_name[term])))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("cell"), pa.array(size, pa.int32()), terms, pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32()))], ["key", "cell", "dl", "terms", "tfs"])


def blocks(rows: DataFrame, average: float) -> DataFrame:
    """(bucket, cell, term, bound, keys, tfs, dls) of a forward table: documents are dealt by cell, and a cell is inverted where it lies."""
    kind = rows.schema["key"].dataType.simpleString()
    dealt = rows.where(F.size("terms") > 0).select("cell", "key", "dl", "terms", "tfs").repartition("cell").sortWithinPartitions("cell")

    def run(batches):
        for cell in _groups(batches, "cell"):
            yield _inverted(cell, average)

    packed = dealt.mapInArrow(run, f"cell int, term string, bound double, keys array<{kind}>, tfs array<int>, dls array<int>")
    return packed.select(_bucket(F.col("term")).alias("bucket"), "cell", "term", "bound", "keys", "tfs", "dls")


def _inverted(rows: pa.Table, average: float) -> pa.RecordBatch:
    """The documents of one cell as a row for each of their terms."""
    terms, tfs = rows.column("terms").combine_chunks(), rows.column("tfs").combine_chunks()
    of = np.repeat(np.arange(rows.num_rows), terms.value_lengths().to_numpy())
    code = terms.flatten().dictionary_encode()
    number = code.indices.to_numpy()
    order = np.argsort(number, kind="stable")
    ends = np.cumsum(np.bincount(number))
    tf, dl = tfs.flatten().to_numpy()[order], rows.column("dl").to_numpy()[of[order]]
    bound = np.maximum.reduceat(tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average)), np.append(0, ends[:-1]))
    keys = rows.column("key").combine_chunks().take(pa.array(of[order]))
    lists = [pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), c) for c in (keys, pa.array(tf, pa.int32()), pa.array(dl, pa.int32()))]
    cell = pa.array(np.full(len(ends), rows.column("cell")[0].as_py(), np.int32))
    return pa.RecordBatch.from_arrays([cell, code.dictionary, pa.array(bound), *lists], ["cell", "term", "bound", "keys", "tfs", "dls"])


def _frequencies(rows: DataFrame, sign: int = 1) -> DataFrame:
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg((F.count("*") * sign).alias("df"))
    return df.select(_bucket(F.col("term")).alias("bucket"), "term", "df")


def _mean(frequencies: DataFrame, documents: int) -> float:
    known = frequencies.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    return known.agg(F.avg(_raw(F.col("df"), documents))).first()[0] or 0.0


def in_memory(docs: DataFrame, key: str, text: str) -> Bm25Index:
    """The same of documents that are asked once: nothing is stored."""
    rows = forward(docs, key, text, 1024).withColumn("segment", F.lit("0"))
    count, total = rows.agg(F.count("*"), F.sum(F.col("dl").cast("long"))).first()
    average = (total or 0) / max(1, count)
    found = _frequencies(rows)
    return Bm25Index(rows, blocks(rows, average or 1.0).withColumn("segment", F.lit("0")), found, None, count, average, _mean(found, count), {"0": average})


# Storing


def _segment(spark: SparkSession, path: str, docs: DataFrame, key: str, text: str, made: DataFrame | None = None) -> tuple[str, dict]:
    """Writes forward table, blocks and frequencies of documents (or of a forward table); the segment's name and facts."""
    name = uuid.uuid4().hex[:12]
    at = f"{path}/segments/{name}"
    rows = made
    if rows is None:
        cells, cores = max(1, -(-docs.count() // CELL)), spark.sparkContext.defaultParallelism
        # Documents that come in fewer parts than there are cores, as from one small file, are dealt out first.
        dealt = docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs
        rows = forward(dealt, key, text, cells)
    rows.write.parquet(at + "/forward")
    rows = spark.read.parquet(at + "/forward")
    count, total, cells = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("dl").cast("long")), F.lit(0)), F.max("cell")).first()
    average = total / count if total else 1.0
    packed = blocks(rows, average).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "cell")
    packed.write.partitionBy("bucket").parquet(at + "/blocks")
    # A term's blocks hold its documents, so frequencies need no second look at the texts.
    df = spark.read.parquet(at + "/blocks").groupBy("bucket", "term").agg(F.sum(F.size("keys")).cast("long").alias("df")) if total else _frequencies(rows)
    df.sortWithinPartitions("bucket", "term").write.parquet(at + "/frequencies")
    return name, {"documents": count, "total": total, "average": average}


def _publish(spark: SparkSession, path: str, segments: dict[str, dict], tokenizer: str, kinds: list[str], after: int | None) -> int:
    count = sum(s["documents"] - s.get("lost", 0) for s in segments.values())
    total = sum(s["total"] - s.get("lost_total", 0) for s in segments.values())
    facts = {"tokenizer": tokenizer, "segments": segments, "documents": count, "total": total, "key": kinds[0]}
    facts["mean"] = _mean(_read(spark, path, segments, "frequencies"), count) if segments else 0.0
    return versions.commit(spark, path, facts, after)


def _read(spark: SparkSession, path: str, segments: dict[str, dict], part: str) -> DataFrame | None:
    out = None
    for name, facts in segments.items():
        if part in ("buried",) and not facts.get("buries"):
            continue
        rows = spark.read.parquet(f"{path}/segments/{name}/{part}").withColumn("segment", F.lit(name)) if part != "buried" else spark.read.parquet(f"{path}/segments/{name}/{part}")
        out = rows if out is None else out.unionByName(rows)
    return out


def write(docs: DataFrame, path: str, key: str, text: str, tokenizer: str, keep: tuple[int, ...] = ()) -> int:
    """One segment of all documents takes the place of what is there."""
    spark = docs.sparkSession
    now = versions.state(spark, path)
    name, facts = _segment(spark, path, docs, key, text)
    number = _publish(spark, path, {name: facts}, tokenizer, [docs.schema[key].dataType.simpleString()], now["number"] if now else 0)
    clean(spark, path, keep)
    return number


def update(docs: DataFrame, gone: DataFrame, path: str, key: str, text: str, tokenizer: str, keep: tuple[int, ...] = ()) -> int:
    """Adds a segment with the documents, whose older versions are buried, as are the keys in the one column of ``gone``."""
    spark = docs.sparkSession
    index = load(spark, path, tokenizer)
    now = versions.state(spark, path)
    segments = dict(now["segments"])
    name, facts = _segment(spark, path, docs, key, text)
    keys = docs.select(F.col(key).alias("key")).unionAll(gone.toDF("key")).distinct()
    lost = _alive(index.forward, index.buried).join(keys, "key", "left_semi")
    at = f"{path}/segments/{name}"
    lost.groupBy("segment", "cell").agg(F.collect_list("key").alias("dead"), F.count("*").alias("n"), F.sum(F.col("dl").cast("long")).alias("total")).write.parquet(at + "/buried")
    buried = spark.read.parquet(at + "/buried")
    by_segment = buried.groupBy("segment").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # a row for each segment
    if by_segment:
        _frequencies(lost, -1).write.mode("append").parquet(at + "/frequencies")
    for r in by_segment:
        was = segments[r.segment]
        segments[r.segment] = was | {"lost": was.get("lost", 0) + r.n, "lost_total": was.get("lost_total", 0) + r.total}
    segments[name] = facts | {"buries": bool(by_segment)}
    number = _publish(spark, path, segments, tokenizer, [docs.schema[key].dataType.simpleString()], now["number"])
    if len(segments) > MOST_SEGMENTS:
        return merge(spark, path, tokenizer, keep)
    clean(spark, path, keep)
    return number


def merge(spark: SparkSession, path: str, tokenizer: str, keep: tuple[int, ...] = ()) -> int:
    """One segment of all live documents, from the forward tables: no text is read."""
    index = load(spark, path, tokenizer)
    now = versions.state(spark, path)
    cell = F.pmod(F.xxhash64(F.lit("cell"), "key"), F.lit(max(1, -(-now["documents"] // CELL)))).cast("int")
    rows = _alive(index.forward, index.buried).select("key", cell.alias("cell"), "dl", "terms", "tfs")
    name, facts = _segment(spark, path, rows, "key", "", made=rows)
    number = _publish(spark, path, {name: facts}, tokenizer, [now["key"]], now["number"])
    clean(spark, path, keep)
    return number


def clean(spark: SparkSession, path: str, keep: tuple[int, ...] = ()) -> None:
    """Deletes segments that neither the last commit nor those in ``keep`` name."""
    known = versions.numbers(spark, path)
    named = {s for n in {*known[-1:], *keep} & set(known) for s in versions.state(spark, path, n)["segments"]}
    where = spark._jvm.org.apache.hadoop.fs.Path(path + "/segments")
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(where):
        for one in store.listStatus(where):
            if one.getPath().getName() not in named:
                delete_folder(spark, one.getPath().toString())
    versions.clean(spark, path, keep)


def load(spark: SparkSession, path: str, tokenizer: str, documents: int | None = None, number: int | None = None) -> Bm25Index:
    """A stored index; ``documents``: how many it has to cover."""
    try:
        now = versions.state(spark, path, number)
    except Exception as error:
        raise IndexMismatch(f"{path} can't be read: {error}") from error
    if now is None:
        raise IndexUnavailable(path)
    if now.get("tokenizer") != tokenizer:
        raise IndexMismatch(f"{path} was made by tokenizer {now.get('tokenizer')}, not {tokenizer}")
    if documents is not None and documents != now["documents"]:
        raise IndexMismatch(f"{path} covers {now['documents']} documents, not {documents}")
    segments = now["segments"]
    buried = _read(spark, path, segments, "buried")
    if buried is not None:
        buried = buried.groupBy("segment", "cell").agg(F.flatten(F.collect_list("dead")).alias("dead"))
    kind = now["key"]
    stored = _read(spark, path, {s: f for s, f in segments.items() if f["total"]}, "blocks")
    if stored is None:
        stored = spark.createDataFrame([], f"cell int, term string, bound double, keys array<{kind}>, tfs array<int>, dls array<int>, bucket int, segment string")
    average = now["total"] / now["documents"] if now["documents"] else 0.0
    return Bm25Index(_read(spark, path, segments, "forward"), stored, _read(spark, path, segments, "frequencies"), buried, now["documents"], average, now["mean"], {s: f["average"] for s, f in segments.items()})


# Asking


class _Scorer:
    """The best documents of each question over the cells that one task meets, and how many blocks it scored."""

    def __init__(self, asked: dict, questions: int, top: int, average: float):
        self.n, self.top, self.average = questions, top, average or 1.0
        self.number = {t: i for i, t in enumerate(asked)}
        who = np.concatenate([p[0] for p in asked.values()])
        order = np.argsort(who, kind="stable")
        # Each question's terms, question by question.
        self.who, self.weight = who[order], np.concatenate([p[1] for p in asked.values()])[order]
        self.term = np.repeat(np.arange(len(asked)), [len(p[0]) for p in asked.values()])[order]
        self.best = Best(questions, top, 0.0)
        self.met, self.scored = np.zeros(questions, np.int64), np.zeros(questions, np.int64)

    def cell(self, rows: pa.Table, stretch: float) -> None:
        """Terms that many questions ask and many documents have are one product of two matrices, weights by impacts; the
        postings of the others are added one by one.  Blocks of terms that nobody asks are passed over."""
        known = np.array([self.number.get(t, -1) for t in rows.column("term").to_pylist()])
        of = np.full(len(self.number), -1)
        of[known[known >= 0]] = np.flatnonzero(known >= 0)
        block = of[self.term]
        here = np.flatnonzero(block >= 0)
        who, weight, block = self.who[here], self.weight[here], block[here]
        bound = rows.column("bound").to_numpy() * stretch
        reach = np.bincount(who, np.maximum(weight, 0) * bound[block], self.n)
        self.met += np.bincount(who, minlength=self.n)
        alive = (reach > 0) & (reach >= self.best.floor - 1e-9)
        if not alive.all():
            kept = alive[who]
            who, weight, block = who[kept], weight[kept], block[kept]
        if not len(who):
            return
        self.scored += np.bincount(who, minlength=self.n)
        lists = rows.column("keys").combine_chunks()
        starts = lists.offsets.to_numpy()
        starts, counts = starts[:-1] - starts[0], np.diff(starts)
        keys = lists.flatten()
        code = keys.dictionary_encode()
        column, names = code.indices.to_numpy(), code.dictionary
        tf, dl = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("tfs", "dls"))
        impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / self.average))
        dead = rows.column("dead").combine_chunks()[0].as_py()
        if dead:
            impact[np.isin(column, np.flatnonzero(pc.is_in(names, pa.array(dead, names.type)).to_numpy(zero_copy_only=False)))] = 0
        names, docs = names.to_numpy(zero_copy_only=False), len(names)
        living = np.flatnonzero(alive)
        who = (np.cumsum(alive) - 1)[who]
        # Scores are first added up in single precision, which says which ones are worth adding up in full; so much they may be off.
        slack = 1e-9 + (np.bincount(who, minlength=len(living)) + 4) * 2.0**-23 * (K1 + 1) * np.bincount(who, np.abs(weight), len(living))
        work = np.bincount(block, minlength=len(counts)) * counts
        wide = np.flatnonzero(work * PRODUCT > len(living) * docs)
        wide = wide[np.argsort(-work[wide], kind="stable")[: CELLS // docs]]
        row = np.full(len(counts), -1)
        row[wide] = np.arange(len(wide))
        at = np.repeat(row, counts)
        impacts = _matrix(at[at >= 0], column[at >= 0], impact[at >= 0], (len(wide), docs))
        many = row[block] >= 0
        wide_who, wide_weight, wide_row = who[many], weight[many], row[block[many]]
        who, weight, block = who[~many], weight[~many], block[~many]
        terms = np.bincount(wide_who, minlength=len(living))
        first = np.cumsum(terms) - terms
        single = impacts.astype(np.float32)
        # By question, in slices of about CELLS postings, weights and scores.
        for a, b in _slices(np.maximum(np.bincount(who, counts[block], len(living)), max(docs, len(wide)))):
            i, j = np.searchsorted(who, (a, b))
            n = counts[block[i:j]]
            # One number for each question, block and posting of the block.
            at = np.repeat(starts[block[i:j]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            alone = _matrix(np.repeat(who[i:j] - a, n), column[at], np.repeat(weight[i:j], n) * impact[at], (b - a, docs))
            i, j = np.searchsorted(wide_who, (a, b))
            weights = np.zeros((b - a, len(wide)), np.float32)
            weights[wide_who[i:j] - a, wide_row[i:j]] = wide_weight[i:j]
            score = weights @ single
            score += alone.astype(np.float32)
            q, d = self.best.reaching(score, living[a:b], slack[a:b])
            for c, e in _slices(terms[a + q]):
                n = terms[a + q[c:e]]
                at = np.repeat(first[a + q[c:e]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                added = np.bincount(np.repeat(np.arange(e - c), n), wide_weight[at] * impacts[wide_row[at], np.repeat(d[c:e], n)], e - c)
                self.best.add(living[a + q[c:e]], names[d[c:e]], np.round(alone[q[c:e], d[c:e]] + added, 9))


def _slices(size: np.ndarray):
    """Stretches of rows of about CELLS together; a larger row is one."""
    edges = np.flatnonzero(np.diff((np.cumsum(size) - size) // CELLS, prepend=-1))
    yield from zip(edges, [*edges[1:], len(size)])


def _matrix(row: np.ndarray, column: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The sums of the values by row and column."""
    return np.bincount(row * shape[1] + column, values, shape[0] * shape[1]).astype(np.float64, copy=False).reshape(shape)


def _groups(batches, *by):
    """The rows that share all of these columns, one group after the other, of batches in that order."""
    rest = []
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [batch.column(c).dictionary_encode().indices.to_numpy() for c in by]
        change = np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], axis=0)) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        if rest and any(rest[-1].column(c)[0] != batch.column(c)[0] for c in by):
            yield pa.Table.from_batches(rest)
            rest = []
        for a, b in zip(edges[:-1], edges[1:]):
            rest.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(rest)
                rest = []
    if rest:
        yield pa.Table.from_batches(rest)


def _weights(questions: DataFrame, index: Bm25Index, qkey: str, qtext: str) -> DataFrame:
    """(qid, term, bucket, weight) of all questions: a term asked twice counts twice."""
    asked = questions.select(qkey, F.explode(tokenize(F.col(qtext))).alias("term")).groupBy(qkey, "term").agg(F.count("*").alias("asked"))
    asked = asked.withColumn("bucket", _bucket(F.col("term")))
    known = index.frequencies.join(F.broadcast(asked.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi").groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df > 0")
    raw = _raw(F.col("df"), index.documents)
    idf = F.when(raw < 0, EPSILON * index.mean).otherwise(raw)
    return asked.join(known, ["bucket", "term"]).select(qkey, "bucket", "term", (F.col("asked") * idf).alias("weight"))


def scores(questions: DataFrame, index: Bm25Index, top: int, qkey: str, qtext: str) -> DataFrame:
    """(qid, key, raw, met, scored): of each task the best documents of each question; and, in rows without a key, how many blocks
    of the question it met and scored.

    The stated questions go out in blocks of about ``BLOCK_BYTES``, with their terms and weights.  All of them share one dealing of
    the index by cell, over as many tasks as there are cores, as each task passes on its best rows."""
    spark = questions.sparkSession
    kind, own = questions.schema[qkey].dataType.simpleString(), index.blocks.schema["keys"].dataType.elementType.simpleString()
    schema = f"{qkey} {kind}, key {own}, raw double, met long, scored long"
    size = questions.agg(F.sum(F.coalesce(F.octet_length(qtext), F.lit(0)) * 2 + 64)).first()[0] or 0
    parts, sent, known, buckets = max(1, -(-size // BLOCK_BYTES)), [], set(), set()
    for part in range(parts):
        rows = _weights(questions.where(F.pmod(F.xxhash64(qkey), F.lit(parts)) == part), index, qkey, qtext).toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        code, term = rows.column(0).combine_chunks().dictionary_encode(), rows.column("term").combine_chunks().dictionary_encode()
        ids, number, weight = code.dictionary.to_pylist(), code.indices.to_numpy(), rows.column("weight").to_numpy()
        order = np.argsort(term.indices.to_numpy(), kind="stable")
        cuts = np.cumsum(np.bincount(term.indices.to_numpy()))[:-1]
        by_term = dict(zip(term.dictionary.to_pylist(), zip(np.split(number[order], cuts), np.split(weight[order], cuts))))
        sent.append(spark.sparkContext.broadcast((ids, by_term, index.average, list(index.built.values()))))
        known.update(by_term)
        buckets.update(rows.column("bucket").unique().to_pylist())
    if not sent:
        return spark.createDataFrame([], schema)

    def search(held):
        def run(batches):
            ids, asked, average, built = held.value
            scorer = _Scorer(asked, len(ids), top, average)
            for rows in _groups(batches, "place"):
                scorer.cell(rows, max(1.0, average / built[rows.column("place")[0].as_py() % len(built)]))
            scorer.best.settle()
            for q, keys, score in scorer.best.found:
                none = pa.nulls(len(q), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids).take(pa.array(q)), pa.array(keys), pa.array(score), none, none], [qkey, "key", "raw", "met", "scored"])
            at = np.flatnonzero(scorer.met)
            if len(at):
                kinds = pa.int64() if own in ("int", "bigint", "smallint") else pa.string()
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at]), pa.nulls(len(at), kinds), pa.nulls(len(at), pa.float64()), pa.array(scorer.met[at]), pa.array(scorer.scored[at])], [qkey, "key", "raw", "met", "scored"])

        return run

    terms = spark.createDataFrame(pa.table({"term": pa.array(list(known))}))
    read = index.blocks.where(F.col("bucket").isin(list(buckets))).join(F.broadcast(terms), "term", "left_semi")
    # Cell and segment as one number, which is quick to sort by.
    segment = F.array_position(F.array(*map(F.lit, index.built)), F.col("segment")) - 1
    live = _live(read, index.buried).select("cell", (F.col("cell") * F.lit(len(index.built)).cast("long") + segment).alias("place"), "term", "bound", "keys", "tfs", "dls", "dead")
    tasks = max(spark.sparkContext.defaultParallelism, -(-index.documents // TASK))
    dealt = live.repartitionById(tasks, "cell").drop("cell").sortWithinPartitions("place")
    return reduce(DataFrame.unionAll, [dealt.mapInArrow(search(held), schema) for held in sent])
