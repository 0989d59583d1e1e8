"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's features are the character n-grams of its letters (lower case; every run of other
characters is one boundary), hashed into a fixed number of buckets.  Each bucket has an
embedding; a text's vector is the mean of its n-grams' embeddings; a linear layer and a
softmax give class probabilities.  Embeddings and layer are learned by stochastic gradient
descent in numpy.  The model being linear after the mean, prediction uses one table of
bucket scores by class.

Training sees a bounded sample: ``per_language`` texts of each language, those with the lowest
hashes of their keys, and of each text ``DRAW`` n-grams at most, drawn by the executors.  Up to
``CALIBRATION`` further texts of each language are held back: they set the softmax temperature
(least log loss) and the rejection threshold.  That is the score below which ``lose`` of the
held-back texts fall, or less, if a lower one already rejects 99 % of what ought to be rejected:
junk of the same letters, and texts of each language under a model that never saw it.  More
than ``MAX_LANGUAGES`` labels: the most frequent ones are learned.

Edges: a null text, or one without a letter, is ``und`` with score 0 and is rejected; rows
whose language is null are never learned from; with no labelled row at all every text is
``und``; ties go to the language that sorts first.  Prediction reads the text alone, whole; a
long one in parts of ``PART`` code points, so that arrays stay bounded.
"""

from __future__ import annotations

import pickle
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.scratch import lean, numbered
from corpusforge.llm.wordhash import mix, slices

#: n-gram lengths; hash buckets; embedding width.
ORDERS, BUCKETS, WIDTH = (1, 2, 3), 1 << 16, 16
UNKNOWN = "und"
SLICE_BYTES, PART = 1 << 17, 1 << 16
DRAW, CALIBRATION, MAX_LANGUAGES = 1000, 1000, 500

MARK, LETTER = 1, 2
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """LETTER or MARK for the code points that are one, else 0."""
    global _letters
    if _letters is None:
        _letters = np.array([{"L": LETTER, "M": MARK}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)
    return _letters


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every n-gram, text of every n-gram, whether each text has a letter)."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer(" ".join(["", *lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    cuts = np.cumsum([0] + [len(t) + 1 for t in lower])  # place of the space before each text
    kind = letters()[points]
    letter = kind > 0
    keep = letter | np.concatenate([[True], letter[:-1]])  # of a run of others, the first is the boundary
    keep[cuts] = True
    owner = np.repeat(np.arange(len(texts) + 1), np.diff(np.append(cuts, len(points))))[keep]
    code = np.where(letter, points, 0)[keep].astype(np.uint64)
    buckets, owners = [], []
    for n in ORDERS:
        if len(code) < n:
            continue
        size = len(code) - n + 1
        h = np.zeros(size, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + code[i : size + i] + np.uint64(1)
        # An n-gram belongs to the text of its first code point; the boundary after a text is the next one's first.
        ok = (owner[n - 1 :] == owner[:size]) | ((code[n - 1 :] == 0) & (owner[n - 2 if n > 1 else 0 :][:size] == owner[:size]))
        ok &= (owner[:size] < len(texts)) if n > 1 else (code > 0)
        buckets.append((mix(h[ok] + np.uint64(n << 50)) >> np.uint64(48)).astype(np.int32) % BUCKETS)
        owners.append(owner[:size][ok])
    has = np.zeros(len(texts) + 1, bool)
    has[owner[kind[keep] == LETTER]] = True
    order = np.argsort(np.concatenate(owners), kind="stable") if owners else np.zeros(0, np.int64)
    return np.concatenate(buckets)[order], np.concatenate(owners)[order], has[:-1]


def sums(table: np.ndarray, bucket: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the rows table[bucket] of each owner, and how many these are."""
    out, count = np.zeros((n, table.shape[1]), np.float64), np.zeros(n, np.int64)
    if len(owner):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[owner[first]] = np.add.reduceat(table[bucket], first, axis=0)
        count[owner[first]] = np.diff(np.append(first, len(owner)))
    return out, count


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # bucket x language
    temperature: float
    threshold: float
    lost: float = 0.0  # share of the held-back texts that the threshold rejects
    passed: float = 0.0  # share of junk and unlearned languages that it lets pass

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(class probabilities, whether there is a letter) of each text."""
        total, count, has = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        long = max(map(len, texts), default=0) > PART
        for at in range(0, max(map(len, texts), default=0) + 1, PART) if long else [None]:
            bucket, owner, letter = grams(texts if at is None else [t[at : at + PART] for t in texts])
            more, n = sums(self.scores, bucket, owner, len(texts))
            total, count, has = total + more, count + n, has | letter
        return softmax(total / np.maximum(count, 1)[:, None] / self.temperature), has

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        p, has = self.probabilities(texts)
        best = p.argmax(axis=1)
        score = np.where(has, p[np.arange(len(texts)), best], 0.0)
        names = [self.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())]
        return names, score, ~has | (score < self.threshold)


def drawn(texts: list[str], limit: int = DRAW) -> list[np.ndarray]:
    """The buckets of each text's n-grams, or of ``limit`` drawn ones; the draw depends on the text alone."""
    out: list[np.ndarray] = []
    for text in texts:
        found = [grams([text[at : at + PART]])[0] for at in range(0, max(len(text), 1), PART)]
        own = np.concatenate(found)
        if len(own) > limit:
            own = own[np.sort(np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass"))).choice(len(own), limit, replace=False))]
        out.append(own)
    return out


def descend(features: list[np.ndarray], y: np.ndarray, classes: int, epochs: int, rate: float, rng) -> np.ndarray:
    """Bucket scores by class, from embeddings and a layer learned by stochastic gradient descent."""
    embedding = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH))
    layer = rng.normal(0, 1 / WIDTH, (WIDTH, classes))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(features)):
            own = features[i]
            # One step on a draw of the text's n-grams, as many as a short text has, so that short texts are learned, too.
            own = own[rng.integers(0, len(own), min(len(own), int(rng.choice([20, 60, 200, 600]))))]
            x = embedding[own].mean(axis=0)
            z = x @ layer
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            pull = layer @ p
            layer -= step * np.outer(x, p)
            np.add.at(embedding, own, -(step * 10 / len(own)) * pull)
    return embedding @ layer


def _raw(scores: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    return np.vstack([scores[f].mean(axis=0) for f in features])


def _temperature(raw: np.ndarray, truth: np.ndarray) -> float:
    tries = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(softmax(raw / t)[np.arange(len(raw)), truth], 1e-12)).mean() for t in tries]
    return float(tries[int(np.argmin(loss))])


def junk(count: int, rng) -> list[np.ndarray]:
    """n-grams of made-up words of Latin letters, in equal odds."""
    alphabet = list("abcdefghijklmnopqrstuvwxyz")
    return drawn([" ".join("".join(rng.choice(alphabet, rng.integers(1, 12))) for _ in range(rng.integers(5, 60))) for _ in range(count)])


def train(fit_on: list[tuple[str, np.ndarray]], held: list[tuple[str, np.ndarray]], epochs: int = 12, rate: float = 0.5, lose: float = 0.0005, seed: int = 7) -> Model:
    """A model of the (language, buckets) pairs to fit on, calibrated by the held-back ones.

    ``lose``: the share of the held-back texts that the rejection threshold may cost.  Where so few
    are held back that it is under one text, half the lowest score is the threshold."""
    fit_on, held = [x for x in fit_on if len(x[1])], [x for x in held if len(x[1])]
    languages = sorted({x for x, _ in fit_on})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    label = {x: i for i, x in enumerate(languages)}
    y, features = np.array([label[x] for x, _ in fit_on]), [f for _, f in fit_on]
    scores = descend(features, y, len(languages), epochs, rate, rng)
    held = [x for x in held if x[0] in label] or fit_on
    truth, held = np.array([label[x] for x, _ in held]), [f for _, f in held]
    raw = _raw(scores, held)
    temperature = _temperature(raw, truth)
    known = np.sort(softmax(raw / temperature).max(axis=1))
    cost = int(lose * len(known))
    keep = float(known[cost]) if cost else float(known[0]) / 2
    strange = [softmax(_raw(scores, junk(200, rng)) / temperature).max(axis=1)]
    if 3 <= len(languages) <= 20:
        for out in range(len(languages)):  # a short training without the language, whose held-back texts are then unknown
            rest = [i for i in rng.permutation(len(y)) if y[i] != out][: 150 * (len(languages) - 1)]
            other = descend([features[i] for i in rest], np.array([y[i] - (y[i] > out) for i in rest]), len(languages) - 1, 4, rate, rng)
            own, theirs = np.flatnonzero(truth != out)[:400], np.flatnonzero(truth == out)[:400]
            if len(own) and len(theirs):
                t = _temperature(_raw(other, [held[i] for i in own]), truth[own] - (truth[own] > out))
                strange.append(softmax(_raw(other, [held[i] for i in theirs]) / t).max(axis=1))
    strange = np.sort(np.concatenate(strange))
    threshold = min(keep, float(strange[int(0.99 * len(strange))]))
    return Model(languages, scores, temperature, threshold, float((known < threshold).mean()), float((strange >= threshold).mean()))


def sample(rows: DataFrame, per_language: int) -> DataFrame:
    """At most per_language of the rows (key, lang, text) of each language, those with the lowest
    key hashes, with place (1, 2, ...) and count.  The counts by language (MAX_LANGUAGES rows at most, so they
    can be broadcast) give the share of hashes that holds about three times as many rows; only these
    are ranked and moved."""
    rows = rows.where("text is not null and lang is not null")
    share = rows.groupBy("lang").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES)
    share = share.withColumn("share", F.least(F.lit(1.0), 3.0 * per_language / F.col("count")))
    rows = rows.withColumn("rank_hash", F.xxhash64("key"))
    near = rows.join(F.broadcast(share), "lang").where(F.col("rank_hash") / 2.0**64 + 0.5 <= F.col("share"))
    first = Window.partitionBy("lang").orderBy("rank_hash", "key", "text")
    return near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= per_language).select("text", "lang", "place", "count")


def fit(docs: DataFrame, use: Column, per_language: int = 400, text: str = "text", lang: str = "lang", key: str = "doc_id", calibration: int = CALIBRATION) -> Model:
    """Train on a bounded sample of the rows that ``use`` selects; what reaches the driver is at most
    (per_language + calibration) * DRAW bucket numbers of each of MAX_LANGUAGES languages.  A fifth of
    a language's rows is held back at least."""
    lean(docs.sparkSession)
    rows = docs.where(use).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.col(key).cast("string").alias("key"))

    def draw(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found = drawn(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("lang", "place", "count")), pa.array(found, pa.list_(pa.int32()))], ["lang", "place", "count", "buckets"])

    got = sample(rows, per_language + calibration).mapInArrow(draw, "lang string, place int, count long, buckets array<int>").toArrow().to_pylist()
    got.sort(key=lambda r: (r["lang"], r["place"]))
    split: tuple[list, list] = [], []
    for r in got:
        # Tiny classes are learned whole: there is nothing to spare.
        trained = min(per_language, r["count"] - r["count"] // 5)
        split[r["place"] > trained].append((r["lang"], np.array(r["buckets"], np.int32)))
    return train(*split)


def predictor(docs: DataFrame, model: Model, columns: list[str], text: str = "text", keep_rejected: bool = True):
    """The columns of docs that are named, then lang_pred, score, rejected; or without rejected rows and just the columns."""
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    loaded: list[Model] = []

    def run(batches):
        if not loaded:
            loaded.append(pickle.loads(held.value))
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                names, score, rejected = loaded[0].predict([t or "" for t in part.column(text).to_pylist()])
                if keep_rejected:
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in columns), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)],
                        [*columns, "lang_pred", "score", "rejected"],
                    )
                else:
                    yield part.filter(pa.array(~rejected)).select(columns)

    return run


def identify(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score, rejected) of each row."""
    rows = docs.select(key, F.col(text).cast("string").alias(text))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(predictor(rows, model, [key], text), f"{key} {kind}, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose language is known, with all their columns."""
    rows, own = numbered(docs, text)
    return rows.mapInArrow(predictor(rows, model, rows.columns, own, keep_rejected=False), rows.schema).toDF(*docs.columns)


def fold(key: str = "doc_id") -> Column:
    """crc32 of the key's decimal text modulo 3; 1 is held out."""
    return F.crc32(F.col(key).cast("string")) % 3
