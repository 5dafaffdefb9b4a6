"""Language by a convolutional network over bytes, trained in numpy.

A window of fixed length passes filters of several widths (one-hot bytes, so a filter is a sum of
table entries), maximum pooling and a softmax layer.  A text's windows, all of them, are scored in
batches and their probabilities averaged by length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import keep
from tidemark.llm.words import texts, tidy

#: Documents of the training sample (a seeded draw), those of each language at least (all, if it has fewer), and
#: windows of each document; they bound what the driver holds.  The network has an output for every language.
SAMPLE, LEAST, WINDOWS = 12_000, 100, 4
#: Bytes of a window, widths of filters, and filters of each width.
LENGTH, WIDTHS, FILTERS = 64, (2, 3, 4), 16
STEPS, BATCH, RATE = 900, 256, 0.01
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LETTER = regex.compile(r"\p{L}")


def _windows(text: bytes) -> np.ndarray:
    """The text's bytes (A-Z in lower case) as rows of LENGTH, the last filled up with zeros."""
    b = np.frombuffer(text.translate(_LOWER), np.uint8)
    n = max(1, -(-len(b) // LENGTH))
    out = np.zeros(n * LENGTH, np.uint8)
    out[: len(b)] = b
    return out.reshape(n, LENGTH)


class ByteNetwork:
    def __init__(self, languages: list[str], seed: int = 8):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.filters = {w: rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        for f in self.filters.values():
            f[:, 0] = 0
        self.dense = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)
        self.pairs = None

    def _responses(self, x: np.ndarray, w: int) -> np.ndarray:
        n = LENGTH - w + 1
        f = self.filters[w]
        out = f[0][x[:, :n]]
        for k in range(1, w):
            out = out + f[k][x[:, k : k + n]]
        return out

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 9) -> None:
        """Cross-entropy by Adam over seeded batches."""
        rng = np.random.default_rng(seed)
        params = [*(self.filters[w] for w in WIDTHS), self.dense, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, STEPS + 1):
            pick = rng.integers(0, len(x), BATCH)
            xb, yb = x[pick].astype(np.int64), y[pick]
            pooled, places = [], []
            for w in WIDTHS:
                r = self._responses(xb, w)
                at = r.argmax(1)
                places.append(at)
                pooled.append(np.take_along_axis(r, at[:, None], 1)[:, 0])
            raw = np.concatenate(pooled, 1)
            hidden = np.maximum(raw, 0)
            logits = hidden @ self.dense + self.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(BATCH), yb] -= 1
            p /= BATCH
            back = (p @ self.dense.T) * (raw > 0)
            grads = []
            for i, w in enumerate(WIDTHS):
                g = np.zeros_like(self.filters[w])
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(w):
                    byte = np.take_along_axis(xb, places[i] + k, 1)
                    np.add.at(g[k], (byte, np.arange(FILTERS)[None, :]), part)
                grads.append(g)
            grads += [hidden.T @ p, p.sum(0)]
            for q, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.pairs = None

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each window; responses are sums of tables by pairs of bytes."""
        if self.pairs is None:
            two = lambda a, b: (a[:, None] + b[None, :]).reshape(65536, FILTERS)
            self.pairs = {w: [two(f[k], f[k + 1]) if k + 1 < w else f[k] for k in range(0, w, 2)] for w, f in self.filters.items()}
        out = np.empty((len(x), len(self.languages)), np.float32)
        for at in range(0, len(x), 512):
            part = x[at : at + 512].astype(np.int32)
            pair = part[:, :-1] * 256 + part[:, 1:]
            pooled = []
            for w in WIDTHS:
                n = LENGTH - w + 1
                tables = self.pairs[w]
                r = tables[0].take(pair[:, :n], 0)
                for k, table in enumerate(tables[1:], 1):
                    r += table.take((pair if len(table) == 65536 else part)[:, 2 * k : 2 * k + n], 0)
                pooled.append(r.max(1))
            logits = np.maximum(np.concatenate(pooled, 1), 0) @ self.dense + self.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            out[at : at + 512] = p / p.sum(1, keepdims=True)
        return out


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, rows = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), texts(batch.column("text"))):
            w = _windows(text)
            for i in np.unique(np.linspace(0, len(w) - 1, WINDOWS).astype(int)):
                langs.append(lang)
                rows.append(w[i].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.binary())], ["lang", "bytes"])


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(docs: DataFrame) -> ByteNetwork | None:
    """A network fitted on the sample of labelled rows that are not held out; None without such rows."""
    told = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out()).select("doc_id", "lang", "text")
    counts = keep(told.groupBy("lang").agg(F.count("*").alias("c")))  # no larger than the network's last layer
    count = counts.agg(F.sum("c")).first()[0] or 0
    rates = counts.select(F.col("lang").alias("name"), F.greatest(F.lit(SAMPLE / max(1, count)), LEAST / F.col("c")).alias("rate"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 30)) / (1 << 30)
    sample = told.withColumn("draw", draw).join(F.broadcast(rates), F.col("lang") == F.col("name")).where("draw < rate")
    table = sample.select("lang", "text").mapInArrow(tidy(_training), "lang string, bytes binary").toArrow()
    if not table.num_rows:
        return None
    names = sorted(set(table["lang"].to_pylist()))
    place = {n: i for i, n in enumerate(names)}
    rows = sorted(zip(table["lang"].to_pylist(), table["bytes"].to_pylist()))
    net = ByteNetwork(names)
    net.train(np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, LENGTH), np.array([place[r[0]] for r in rows]))
    return net


def predicted_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of ``docs``.

    A text that is null or has no letter is ``und`` with score 0, as is every text where nothing can
    be learned.  A very long text is read whole; of equally likely languages the first by name is taken.  A null doc_id counts as the empty text for held_out and is not learned from.
    Repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    net = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def run(batches):
        model = net.value
        for batch in batches:
            langs, scores = [], []
            whole = [x if x and model and _LETTER.search(x) else None for x in batch.column("text").to_pylist()]
            rows = [_windows(x.encode()) for x in whole if x]
            if rows:
                p = np.log(np.maximum(model.probabilities(np.concatenate(rows)), 1e-6))
                starts = np.r_[0, np.cumsum([len(r) for r in rows])]
            i = 0
            for x in whole:
                if x is None:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                part = p[starts[i] : starts[i + 1]]
                weights = np.full(len(part), 1.0)
                weights[-1] = max(1, len(x.encode()) - (len(part) - 1) * LENGTH) / LENGTH
                mean = np.exp(weights @ part / weights.sum())
                best = int(mean.argmax())
                langs.append(model.languages[best])
                scores.append(float(mean[best] / mean.sum()))
                i += 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")
    return slim.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
