"""MinHash near-dedup by a signature-coordinate inverted join.

1. Every text gets the set of its distinct word shingles and a signature of ``COORDINATES``
   minima.  Equal sets form a class; only its representative goes on.
2. A representative is posted under each of its coordinate-value pairs.  Pairs that occur
   once are skipped.  Two texts that agree in ``match`` coordinates or more must share one
   of their c - match + 1 rarest pairs (c: pairs left), so only this prefix is posted for
   merging; a text with c < match is skipped altogether.
3. All members of a posting list meet at the list's leader, the member whose pairs are the
   most frequent (in a group of near copies, their common source).  Lists with the same
   leader are merged, so that a text comes once for each leader, and never in pairs.
4. A leader's group of more than ``GROUP_SHINGLES`` is cut into blocks, each with the leader.
   In a block collisions of signatures are counted, and pairs with ``match`` or more are
   confirmed on full shingle sets: first the leader against all, then whoever isn't yet in the
   leader's component against all.  What comes out is one star for each component found.
   Texts of a cut group that the leader doesn't reach then go to every block of the group; so
   the work grows with the group's size, and beyond that only with what isn't near its leader.
5. The stars' connected components are the result.

``match`` is the largest number of agreeing coordinates that two texts at the similarity
threshold miss with odds of at most ``MISS``.

Edges: a null or empty text, or one of spaces, has an empty set and is linked with nothing;
with fewer words than a shingle the whole sequence is the one shingle; rows with a null key
are linked with nothing and stay; rows that repeat key and text have one fate (of such rows
with different other columns the one with the least hash of these stays); other columns
are ignored.  Texts are told apart by key and a 64-bit hash, sets by 128 bits.

Hot keys: tables that are joined to a large side are written first, so that Spark can split a
partition of the large side that one key fills; counts and least values are folded before they
move.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.components import components
from corpusforge.llm.scratch import discard, lean, written
from corpusforge.llm.wordhash import FOLD_ASCII, SPACES, WORD_BASE, Words, mix, range_hashes, slices

COORDINATES, MISS, GROUP_SHINGLES = 32, 1e-6, 1 << 15
SEED = 20


def match_threshold(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    s, below = percent / 100, 0.0
    for k in range(coordinates + 1):
        below += comb(coordinates, k) * s**k * (1 - s) ** (coordinates - k)
        if below > miss:
            return max(1, k)
    return coordinates


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, hash) of the distinct shingles of each text in order, and the number of texts."""
    words = Words(column, SPACES, FOLD_ASCII)
    begin, code = words.windows(size)
    owner = words.owner()[begin]
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    whole = mix(range_hashes(words.hash, words.first[short], words.first[short + 1], WORD_BASE) + words.count[short].astype(np.uint64))
    owner, code = np.concatenate([owner, short]), np.concatenate([code, whole])
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    if len(code):
        new = np.concatenate([[True], (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])])
        owner, code = owner[new], code[new]
    return owner, code, len(words)


FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(code: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The signature of each set: for every coordinate the least of its multiplied hashes; sets come in order, count has their sizes."""
    low = np.zeros((len(count), COORDINATES), np.int32)
    has = count > 0
    first = (np.cumsum(count) - count)[has]
    if len(code):
        for i, factor in enumerate(FACTORS):
            low[has, i] = (np.minimum.reduceat(code * factor, first) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return low


def _signatures(size: int):

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                owner, code, n = shingles(part.column("text"), size)
                count = np.bincount(owner, minlength=n)
                has = count > 0
                first = (np.cumsum(count) - count)[has]
                sums = np.zeros((2, n), np.uint64)
                low = minima(code, count)
                if len(code):
                    for i, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                        sums[i, has] = np.add.reduceat(mix(code ^ np.uint64(salt)), first)
                bounds = pa.array(np.arange(n + 1) * COORDINATES, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("d"),
                        part.column("x"),
                        pa.array(count, pa.int64()),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        pa.ListArray.from_arrays(bounds, pa.array(low.ravel())),
                    ],
                    ["d", "x", "n", "s1", "s2", "low"],
                )

    return run


class _Block:
    """Texts whose links are to be confirmed, with a union-find over them."""

    def __init__(self, texts: list[tuple[int, int, np.ndarray]], match: int, percent: int):
        self.node = [(d, x) for d, x, _ in texts]
        self.code = [c for _, _, c in texts]
        self.count = np.array([len(c) for c in self.code])
        self.low = minima(np.concatenate(self.code), self.count)
        self.root = list(range(len(texts)))
        self.match, self.percent = match, percent

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def compare(self, i: int):
        """Links text i with all that are near it."""
        own = self.code[i]
        for j in np.flatnonzero((self.low == self.low[i]).sum(axis=1) >= self.match).tolist():
            a, b = self.find(i), self.find(j)
            if a != b:
                other = self.code[j]
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                common = int((own[at] == other).sum())
                if 100 * common >= self.percent * (len(own) + len(other) - common):
                    self.root[a] = b

    def stars(self):
        """(least, other) of each component."""
        members: dict[int, set[tuple[int, int]]] = {}
        for i, node in enumerate(self.node):
            members.setdefault(self.find(i), set()).add(node)
        for nodes in members.values():
            least = min(nodes)
            for node in nodes - {least}:
                yield *least, *node


def _grouped(size: int, columns: list[str]):
    """(key, texts) for each run of rows with equal (ld, lx, tile); texts are (d, x, shingles), then the values of columns."""

    def run(batches):
        key, held = None, []
        for batch in batches:
            for part in slices(batch, "text"):
                owner, code, n = shingles(part.column("text"), size)
                cut = np.searchsorted(owner, np.arange(n + 1)).tolist()
                rows = zip(*(part.column(c).to_pylist() for c in ("ld", "lx", "tile", "d", "x", *columns)))
                for i, (ld, lx, tile, d, x, *more) in enumerate(rows):
                    if key != (ld, lx, tile):
                        if held:
                            yield key, held
                        key, held = (ld, lx, tile), []
                    held.append((d, x, code[cut[i] : cut[i + 1]], *more))
        if held:
            yield key, held

    return run


def _link_batches(found, limit: int = 1 << 14):
    """Batches of (rest, ad, ax, bd, bx)."""
    held: list[tuple] = []

    def batch():
        columns = list(zip(*held)) or [[]] * 5
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.bool_()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["rest", "ad", "ax", "bd", "bx"])

    for row in found:
        held.append(row)
        if len(held) >= limit:
            yield batch()
    yield batch()


def _stars(size: int, percent: int):
    """Confirms links inside the blocks (leader, tile) of rows that come sorted by block; of a cut group
    also gives (leader, text), marked as rest, for each text that isn't in the leader's component."""
    match = match_threshold(percent)

    def links(batches):
        for (ld, lx, _), texts in _grouped(size, ["blocks"])(batches):
            if len(texts) < 2:
                continue
            block = _Block([t[:3] for t in texts], match, percent)
            main = block.node.index((ld, lx))
            block.compare(main)
            for i in range(len(texts)):
                if block.find(i) != block.find(main):
                    block.compare(i)
            for star in block.stars():
                yield False, *star
            if texts[0][3] > 1:
                for i, node in enumerate(block.node):
                    if block.find(i) != block.find(main):
                        yield True, ld, lx, *node

    return lambda batches: _link_batches(links(batches))


def _rest_links(size: int, percent: int):
    """Confirms the links of the marked rows of each tile with all its rows."""
    match = match_threshold(percent)

    def links(batches):
        for _, texts in _grouped(size, ["open"])(batches):
            block = _Block([t[:3] for t in texts], match, percent)
            for i, text in enumerate(texts):
                if text[3]:
                    block.compare(i)
            for star in block.stars():
                yield False, *star

    return lambda batches: _link_batches(links(batches))


def signatures(docs: DataFrame, size: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(d, x, n, s1, s2, low): key, text hash, set size, set hash, signature."""
    return _rows(docs, text, key).mapInArrow(_signatures(size), "d long, x long, n long, s1 long, s2 long, low array<int>")


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    rows = docs.select(F.col(key).cast("long").alias("d"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.select("d", F.xxhash64("text").alias("x"), "text")


def leader_groups(classes: DataFrame, match: int) -> DataFrame:
    """(ld, lx, d, x, n), written: the members of each leader's group."""
    posts = classes.select("d", "x", "n", F.posexplode("low").alias("i", "v"))
    posts = posts.select("d", "x", "n", F.expr("shiftleft(cast(i as long), 32) | (cast(v as long) & 4294967295)").alias("k"))
    often = written(posts.groupBy("k").agg(F.count("*").alias("often")).where("often > 1"))
    by_text = posts.join(often, "k").groupBy("d", "x", "n").agg(F.sort_array(F.collect_list(F.struct("often", "k"))).alias("ks"))
    by_text = by_text.where(F.size("ks") >= match).select(
        "d", "x", "n",
        F.expr("aggregate(ks, 0D, (a, p) -> a + ln(p.often))").alias("weight"),
        F.expr(f"slice(ks, 1, size(ks) - {match} + 1)").alias("ks"),
    )
    lists = written(by_text.select("d", "x", "n", "weight", F.explode("ks.k").alias("k")))
    lead = lists.groupBy("k").agg(F.count("*").alias("members"), F.max(F.struct("weight", F.negative("d").alias("d"), "x")).alias("top"))
    lead = written(lead.where("members > 1").select("k", F.negative("top.d").alias("ld"), F.col("top.x").alias("lx")))
    members = written(lists.join(lead, "k").select("ld", "lx", "d", "x", "n").distinct())
    discard(often, lists, lead)
    return members


def _blocks(members: DataFrame, limit: int, name: str) -> DataFrame:
    """(ld, lx, name): into how many blocks each group is cut; the largest text fills a quarter of a block at most."""
    count = F.ceil(F.sum("n") / F.greatest(F.lit(limit), 4 * F.max("n"))).cast("int")
    return members.groupBy("ld", "lx").agg(count.alias(name))


def _links(docs: DataFrame, classes: DataFrame, size: int, percent: int, text: str, key: str, limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """Confirmed links (ad, ax, bd, bx), and the tables they are read from."""
    members = leader_groups(classes, match_threshold(percent))
    sizes = written(_blocks(members, limit, "blocks"))
    members, own = members.join(sizes, ["ld", "lx"]).withColumn("block", F.expr("cast(pmod(xxhash64(d, x), blocks) as int)")), members
    kind = "rest boolean, ad long, ax long, bd long, bx long"

    def met(rows: DataFrame, mark: str, found) -> DataFrame:
        """found over the rows (ld, lx, tile, d, x, mark) with their texts, dealt and sorted by tile."""
        texts = rows.join(_rows(docs, text, key), ["d", "x"]).select("ld", "lx", "tile", "d", "x", mark, "text")
        dealt = texts.repartition("ld", "lx", "tile").sortWithinPartitions("ld", "lx", "tile", "d", "x")
        return written(dealt.mapInArrow(found(size, percent), kind))

    is_leader = (F.col("d") == F.col("ld")) & (F.col("x") == F.col("lx"))
    tile = F.explode(F.when(is_leader, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block")))
    stars = met(members.select("ld", "lx", tile.alias("tile"), "d", "x", "blocks"), "blocks", _stars)
    links, tables = stars.where(~F.col("rest")), [own, sizes, stars]
    rest = stars.where("rest").select(F.col("ad").alias("ld"), F.col("ax").alias("lx"), F.col("bd").alias("d"), F.col("bx").alias("x")).distinct()
    if not rest.isEmpty():
        # Tile i * blocks + j holds block i of the rest and block j of the group.
        rest = written(members.join(rest, ["ld", "lx", "d", "x"]))
        parts = written(_blocks(rest, limit, "parts"))
        open_rows = rest.join(parts, ["ld", "lx"]).withColumn("part", F.expr("pmod(xxhash64(x, d), parts)"))
        open_rows = open_rows.select("ld", "lx", F.expr("explode(transform(sequence(0, blocks - 1), j -> part * blocks + j))").alias("tile"), "d", "x", F.lit(True).alias("open"))
        all_rows = members.join(parts, ["ld", "lx"]).select("ld", "lx", F.expr("explode(transform(sequence(0, parts - 1), i -> cast(i as long) * blocks + block))").alias("tile"), "d", "x", F.lit(False).alias("open"))
        more = met(open_rows.union(all_rows), "open", _rest_links)
        links, tables = links.union(more), [*tables, rest, parts, more]
    return links.drop("rest"), tables


def _judged(docs: DataFrame, size: int, percent: int, text: str, key: str, limit: int) -> DataFrame:
    """(d, x, n, component, kept) of each row."""
    lean(docs.sparkSession)
    marked = written(signatures(docs, size, text, key))
    usable = marked.where("n > 0 and d is not null")
    classes = usable.groupBy("s1", "s2").agg(F.min(F.struct("d", "x", "n", "low")).alias("c")).select("s1", "s2", "c.*")
    classes = written(classes)
    links, tables = _links(docs, classes, size, percent, text, key, limit)
    node = {c: F.struct(F.col(f"{c}d").alias("d"), F.col(f"{c}x").alias("x")).alias(c) for c in "ab"}
    labels = components(links.select(node["a"], node["b"]))
    discard(*tables)
    found = labels.select("node.d", "node.x", F.col("label").alias("least"))
    of_class = classes.select("s1", "s2", "d", "x").join(found, ["d", "x"], "left").select("s1", "s2", F.coalesce("least", F.struct("d", "x")).alias("least"))
    of_class = written(of_class)
    discard(classes, labels)
    # Texts without a set all have the same hash; they are spread by their own.
    linked = (F.col("n") > 0) & F.col("d").isNotNull()
    spread = {s: F.when(linked, F.col(s)).otherwise(F.coalesce(c, F.lit(0))).alias(s) for s, c in (("s1", F.xxhash64("d")), ("s2", F.col("x")))}
    out = marked.select("d", "x", "n", *spread.values()).join(of_class, ["s1", "s2"], "left")
    least = F.when(linked, F.col("least")).otherwise(F.struct("d", "x"))
    return out.select("d", "x", "n", least.alias("least"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id", limit: int = GROUP_SHINGLES) -> DataFrame:
    """(key, n_shingles, component_id, kept): links at a Jaccard similarity of percent or more
    between sets of size-word shingles; component_id is the least key that can be reached."""
    out = _judged(docs, size, percent, text, key, limit)
    kept = F.coalesce(F.col("d") == F.col("least.d"), F.lit(True)).alias("kept")
    return out.select(F.col("d").alias(key), F.col("n").alias("n_shingles"), F.col("least.d").alias("component_id"), kept)


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id", limit: int = GROUP_SHINGLES) -> DataFrame:
    """One row of each component, the one with the least key, with all its columns."""
    judged = _judged(docs, size, percent, text, key, limit)
    stay = judged.where(F.col("least") == F.struct("d", "x")).select(F.coalesce("d", F.lit(-(1 << 63))).alias("d"), "x").distinct()
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    row = F.struct(*map(_quoted, docs.columns)).alias("row")
    tie = F.xxhash64(*(_quoted(f.name) for f in docs.schema if f.dataType.typeName() not in ("map", "variant")))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(body).alias("x"), tie.alias("tie"), row)
    # A row that repeats key and text is the same document once more.
    return rows.join(stay, ["d", "x"], "left_semi").groupBy("d", "x").agg(F.min_by("row", "tie").alias("row")).select("row.*")


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"
