"""Toxicity by class-conditional Kneser-Ney models over characters.

Two models of the next character after ORDER - 1 others, one of toxic and one of ordinary texts, back off to
one interpolated Kneser-Ney model whose continuation counts both classes share; so what is rare is
smoothed alike and only what a class really repeats speaks for it.  A text's log-likelihood ratio,
normalised by length over the whole text, over its most toxic words and over what its words have beyond
some ratio, goes through a logistic curve fitted on labelled texts that the counts have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.store import keep
from tidemark.llm.words import release, tidy

#: Labelled rows of each class that are learned from at most (a seeded sample beyond it), and those that fit the curve.
LABELLED, CURVE = 1_000_000, 40_000
#: Characters of the longest gram.
ORDER = 6
#: Discount of every order, and times that one document counts for a gram: what few documents have is left to the backoff.
DISCOUNT, PER_TEXT = 6.0, 8
#: Numbers of most toxic words whose ratios are averaged, and the ratios whose excess is summed over all words.
TOP, BEYOND = (1, 2, 4, 8), (2.0, 3.0)
#: Characters that are looked up together, unless one text has more.
TOGETHER = 1 << 15
#: Bits of a table's places: all characters or pairs, else these at least, and so many that SPARE places come to a gram.
_BITS, SPARE = {1: 8, 2: 16, 3: 20, 4: 20, 5: 21, 6: 21}, 4
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.array([32 if b in b"\t\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
#: Each number of half precision from 0 on at single precision: to look it up takes a fifth of the time of a conversion.
_SINGLE = np.arange(0x7C01, dtype=np.uint16).view(np.float16).astype(np.float32)
_BEFORE = np.full(ORDER - 1, 32, np.uint64)


def _packed(text: str) -> np.ndarray:
    """Each character, in a byte, with those before it; characters beyond 255 share bytes."""
    return _grams(_bytes(text))


def _bytes(text: str) -> np.ndarray:
    """A byte for each character, after the spaces that stand before a text."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.concatenate([_BEFORE, _LOWER[(c ^ (c >> 8)) & 255]])


def _grams(b: np.ndarray) -> np.ndarray:
    n = len(b) - ORDER + 1
    out = b[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        out |= b[ORDER - 1 - k : ORDER - 1 - k + n] << np.uint64(8 * k)
    return out


def _slot(grams: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Places of grams (their last ``order`` characters) in the table of that order, of 2 ** ``bits`` places."""
    low = grams & np.uint64((1 << 8 * order) - 1)
    return low.astype(np.int64) if order < 3 else ((low + np.uint64(order)) * _MIX >> np.uint64(64 - bits)).astype(np.int64)


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


class ToxicityModel:
    """Tables of discounted probabilities and backoff weights; their sizes grow with what the counts hold.

    ``levels`` has for the two classes (ORDER characters) and each lower order the grams counted more often
    than the discount, their counts, and the contexts that have such a gram with the total and the discounts of
    all of their grams.  Any other gram has nothing left after the discount, and a context of such grams alone
    backs off with weight 1 as an unseen one does, so neither needs a place.
    """

    def __init__(self, levels: dict):
        self.bits = dict(_BITS)
        for name, (grams, _, contexts, _, _) in levels.items():
            order = name if isinstance(name, int) else ORDER
            for k, n in ((order, len(grams)), (order - 1, len(contexts))):
                if k > 2:
                    self.bits[k] = max(self.bits[k], (SPARE * n).bit_length())
        self.seen, self.rest = {}, {}
        for name, level in levels.items():
            self.seen[name], self.rest[name] = self._level(*level, name if isinstance(name, int) else ORDER)
        self.weights = np.zeros(len(TOP) + len(BEYOND) + 4)

    def __getstate__(self):
        """Tables are at half precision and travel compressed, being mostly empty."""
        squeeze = lambda tables: {k: zstandard.compress(v.tobytes(), 3) for k, v in tables.items()}
        return squeeze(self.seen), squeeze(self.rest), self.weights, self.bits

    def __setstate__(self, state):
        expand = lambda tables: {k: np.frombuffer(zstandard.decompress(v), np.float16) for k, v in tables.items()}
        self.seen, self.rest, self.weights, self.bits = expand(state[0]), expand(state[1]), state[2], state[3]

    def _level(self, grams, counts, contexts, totals, discounts, order):
        place = lambda x: _slot(x, order - 1, self.bits[order - 1]) if order > 1 else np.zeros(len(x), np.int64)
        size = 1 << self.bits[order - 1] if order > 1 else 1
        total = np.bincount(place(contexts), totals, size)
        taken = np.bincount(place(contexts), discounts, size).astype(float)
        np.divide(taken, total, out=taken, where=total > 0)
        taken[total <= 0] = 1
        seen = np.zeros(1 << self.bits[order], np.float16)
        np.maximum.at(seen, _slot(grams, order, self.bits[order]), ((counts - DISCOUNT) / np.maximum(total[place(grams >> np.uint64(8))], 1)).astype(np.float16))
        return seen, taken.astype(np.float16)

    def ratios(self, text: str) -> np.ndarray:
        """log P(character | toxic) - log P(character | ordinary) for each character."""
        return self._ratios(_packed(text))

    def _ratios(self, grams: np.ndarray) -> np.ndarray:
        """Those of the last character of each of ``grams``, which follow each other from the beginning of a text.

        What comes before a character is what its predecessor ends with, so a context's place is the predecessor's.
        """
        of = lambda table, at: _SINGLE.take(table.view(np.uint16).take(at))
        start = np.array([int.from_bytes(b" " * ORDER, "little")], np.uint64)
        slots = {k: np.concatenate([_slot(start, k, self.bits[k]), _slot(grams, k, self.bits[k])]) for k in range(1, ORDER)}
        whole = _slot(grams, ORDER, self.bits[ORDER])
        p = of(self.seen[1], slots[1][1:]) + float(self.rest[1][0]) / 256
        for k in range(2, ORDER):
            p = of(self.seen[k], slots[k][1:]) + of(self.rest[k], slots[k - 1][:-1]) * p
        context = slots[ORDER - 1][:-1]
        toxic = of(self.seen["toxic"], whole) + of(self.rest["toxic"], context) * p
        ordinary = of(self.seen["ordinary"], whole) + of(self.rest["ordinary"], context) * p
        return np.log(np.maximum(toxic, 1e-12) / np.maximum(ordinary, 1e-12))

    def features(self, texts: list[str]) -> list[list[float]]:
        """Of each text; short ones are looked up together, which changes no value."""
        out: list[list[float]] = []
        held: list[np.ndarray] = []
        size = 0
        for n, text in enumerate(texts):
            held.append(_bytes(text))
            size += len(held[-1])
            if size >= TOGETHER or n == len(texts) - 1:
                grams = _grams(np.concatenate(held))
                ratios, at = self._ratios(grams), 0
                for b in held:  # the places between two texts are those of the spaces before the second
                    to = at + len(b) - ORDER + 1
                    out.append(self._features(grams[at:to], ratios[at:to]))
                    at += len(b)
                held, size = [], 0
        return out

    def _features(self, grams: np.ndarray, ratios: np.ndarray) -> list[float]:
        n = len(grams)
        if not n:
            return [0.0] * (len(self.weights) - 1)
        total = np.concatenate([[0.0], np.cumsum(ratios, dtype=np.float64)])
        space = grams[1:] & np.uint64(255) == 32
        start = np.flatnonzero(np.r_[True, space])  # a word has the space before it
        best = np.sort(np.maximum.reduceat(total[1:], start) - total[start])[::-1]  # over the beginnings of each word
        out = [total[-1] / n, *(np.maximum(best[:k], 0).sum() / k for k in TOP), *(10 * np.maximum(best - x, 0).sum() / len(best) for x in BEYOND)]
        return [float(x) for x in (*out, np.log1p((best > BEYOND[0]).sum()), np.log1p(len(best)))]

    def scores(self, texts: list[str]) -> list[float]:
        found = [np.r_[x, 1.0] @ self.weights for x in self.features(texts)]
        return [float(1 / (1 + np.exp(-np.clip(x, -30, 30)))) for x in found]

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression by damped Newton steps."""
        if not len(x):
            return
        x = np.c_[x, np.ones(len(x))]
        scale = np.maximum(np.abs(x).max(0), 1e-9)
        z, w = x / scale, np.zeros(x.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (p - y) + 1e-3 * w
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(len(w)), grad)
            w -= np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w / scale


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of a task's texts with their counts in toxic and ordinary texts."""
    held: tuple[list, list] = ([], [])  # (grams, counts) of texts
    sums = [(np.empty(0, np.uint64), np.empty(0, np.int64)) for _ in range(2)]
    size = 0

    def merged(c):
        if not held[c]:
            return sums[c]
        kinds, where = np.unique(np.concatenate([sums[c][0], *(g for g, _ in held[c])]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([sums[c][1], *(n for _, n in held[c])])).astype(np.int64)
        held[c].clear()
        return kinds, counts

    for batch in batches:
        for toxic, text in zip(batch.column("toxic").to_pylist(), _texts(batch.column("text"))):
            g, n = np.unique(_packed(text), return_counts=True)
            held[1 - toxic].append((g, np.minimum(n, PER_TEXT)))
            size += len(g)
            if size > 1_000_000:
                sums, size = [merged(0), merged(1)], 0
    sums = [merged(0), merged(1)]
    for c in (0, 1):
        for at in range(0, len(sums[c][0]), 200_000):
            g, n = sums[c][0][at : at + 200_000].view(np.int64), sums[c][1][at : at + 200_000]
            none = np.zeros(len(n), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(none if c else n), pa.array(n if c else none)], ["gram", "toxic", "ordinary"])


def _levels(grams: DataFrame) -> dict:
    """What ToxicityModel needs of each level; all grams count in the totals and as continuations."""
    out = {}

    def add(name, table):
        many = table.where(F.col("c") > DISCOUNT).toArrow()
        discount = F.least(F.col("c").cast("double"), F.lit(DISCOUNT))
        sums = table.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("c").cast("double").alias("total"), F.sum(discount).alias("taken"), F.max("c").alias("most"))
        of = sums.where(F.col("most") > DISCOUNT).select("context", "total", "taken").toArrow()
        codes = lambda x: x.to_numpy().astype(np.int64).view(np.uint64)
        out[name] = codes(many["gram"]), many["c"].to_numpy().astype(float), codes(of["context"]), of["total"].to_numpy().astype(float), of["taken"].to_numpy().astype(float)

    for name in ("toxic", "ordinary"):
        add(name, grams.where(f"{name} > 0").select("gram", F.col(name).alias("c")))
    types = grams
    for order in range(ORDER - 1, 0, -1):
        types = keep(types.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("c")))
        add(order, types)
    return out


def held_out(column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The model of the labelled documents that are not held out; labels of one doc_id: the greatest counts."""
    spark = docs.sparkSession
    marks = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    count = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    marks = marks.where(draw < F.when(F.col("toxic") == 1, min(1.0, LABELLED / max(1, count.get(1, 0)))).otherwise(min(1.0, LABELLED / max(1, count.get(0, 0)))))
    marks = marks.withColumn("curve", F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(4)) == 0)
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks), "doc_id")  # at most 2 * LABELLED ids
    grams = keep(told.where("not curve").select("toxic", "text").mapInArrow(tidy(_counted), "gram long, toxic long, ordinary long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
    model = ToxicityModel(_levels(grams))
    release()
    shared = spark.sparkContext.broadcast(model)  # without the curve yet

    def curve(batches):
        for batch in batches:
            found = shared.value.features(_texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.float64()))], ["toxic", "x"])

    rate = min(1.0, CURVE / max(1, sum(count.values()) / 4))
    points = told.where("curve").where(draw < rate).select("toxic", "text").mapInArrow(tidy(curve), "toxic int, x array<double>").toArrow()
    if points.num_rows:
        model.fit(np.array(points["x"].to_pylist()), points["toxic"].to_numpy().astype(float))
    shared.unpersist()
    return model


def _scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with a column score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    del model
    release()
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            found = shared.value.scores(_texts(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.3) of each row of ``docs``.

    A null or empty text gets the score of a text without evidence.  Without labels every score is
    one half.  A null doc_id counts as the empty text for held_out.  A very long text is scored whole.  Repeated
    rows stay and score alike; an empty table gives an empty result; other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = _scores(slim, learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score 0.3 or more.

    Null and empty texts score what a text without evidence scores.  Repeated rows stay or go alike; columns keep
    their names, types and order; an empty table gives an empty result.
    """
    plain = docs.toDF(*(f"_{i}" if c != "text" else c for i, c in enumerate(docs.columns)))
    return _scores(plain, learn(docs, labels)).where("score < 0.3").drop("score").toDF(*docs.columns)
