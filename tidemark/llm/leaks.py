"""Benchmark passages in documents, by latent semantic retrieval.

Benchmark items and documents are cut into overlapping passages with TF-IDF weights over the items' words
(document frequencies of all documents; a word that no item has stands in no item's passage and has no
coordinate).  A randomised SVD of the items' passages, whose products are summed over partitions, gives the
latent space, cut where its singular values hold ENERGY of the whole; a document's passages are folded in
and compared with the items' by cosine there.  First of all each passage is held against the greatest
weights of small groups of item passages: where not even their sum comes near, no item's cosine can.
Passages that share RUN words in a row with an item are candidates too, whatever their words weigh.  What
comes near is a candidate only: the longest common subsequence with the item and, for looser matches, the
item's answer (its last words) decide.

What the cut takes from an item's passage is made up for by the share that it leaves, so that a verbatim
copy has the cosine 1 however many directions are left.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import texts, tidy

#: Words of half a passage; passages start at every half and end with the next.
HALF = 14
PASSAGE = 2 * HALF
#: Least weight of a word: those that all documents have count too.
LEAST = 0.05
#: Words in a row that make a candidate.
RUN = 3
#: Cosine of candidates; shares of an item's words, in order, that prove it alone or with its answer.
NEAR, PROVED, LIKELY, ANSWER = 0.45, 0.75, 0.5, 6
#: Words of items that a passage has at least, for the cosine to be asked (all that an item proves itself by, if that is less).
KNOWN = 4
#: Share of the squared singular values that the latent space keeps, and directions that the range finder takes besides.
ENERGY, SPARE = 0.95, 8
#: Passages of the items in a block, about, which has a latent space of its own, and passages of a group in it.
BLOCK, GROUP = 512, 8
#: Blocks that are broadcast and searched together; with BLOCK it bounds the size of what is broadcast.
TOGETHER = 4
#: Tasks that add up the products of one block's passages.
PARTS = 4
#: Words of texts that are folded in at once.
AT_ONCE = 1 << 17
_MARKS = bytes(range(33, 48)) + b":;?@[]^_`{|}~" + b"\\"
_LOWER = bytes(range(256)).lower()


def _words(text: bytes) -> list[bytes]:
    return text.translate(_LOWER, _MARKS).split()


def _ids(words: list[bytes], terms: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(terms.get, words, repeat(0)), np.int32, len(words))


def _frequencies(shared):
    """Of each term of the items the number of a task's texts that have it; of 0 that of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        seen = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            for text in texts(batch.column("text")):
                seen[np.fromiter(filter(None, map(terms.get, set(_words(text)))), np.int64)] += 1
            seen[0] += batch.num_rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["term", "c"])

    return tidy(run)


def weights(docs: DataFrame, terms: dict[bytes, int]) -> np.ndarray:
    """Inverse document frequency of each term over all documents; 0 at place 0, for words that are none."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    table = docs.select("text").mapInArrow(_frequencies(shared), "term long, c long").groupBy("term").agg(F.sum("c").alias("c")).toArrow()
    shared.unpersist()
    seen = np.zeros(len(terms) + 1)
    seen[table["term"].to_numpy()] = table["c"].to_numpy()
    out = np.maximum(np.log((1 + seen[0]) / (1 + seen)), LEAST).astype(np.float32)
    out[0] = 0
    return out


def _item_passages(ids: np.ndarray) -> list[np.ndarray]:
    return [ids[at : at + PASSAGE] for at in range(0, max(1, len(ids) - HALF), HALF)] if len(ids) else []


def _unit(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    terms, counts = np.unique(ids, return_counts=True)
    w = counts * idf[terms]
    return terms, (w / np.sqrt((w * w).sum())).astype(np.float32)


def latent_space(items: DataFrame, terms: dict[bytes, int], idf: np.ndarray, rank: int, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """The right singular vectors (terms x directions, ``rank`` at most) and singular values of the items' TF-IDF passages A, by a randomised SVD.

    Each task adds up A'(A X) of its passages, twice: for a seeded random X and for the orthonormal basis of
    the first sum; then the Gram matrix of A Q, whose eigenvectors turn Q.  The first directions that hold
    ENERGY of the squared singular values stay.
    """
    spark = items.sparkSession
    size = len(terms) + 1
    width = min(rank + SPARE, size)

    def passages(batches):
        words, idf, basis = shared.value
        basis = np.random.default_rng(seed).normal(size=(size, width)) if basis is None else basis
        for batch in batches:
            for text in texts(batch.column("text")):
                for ids in _item_passages(_ids(_words(text), words)):
                    at, w = _unit(ids, idf)
                    yield at, w, w @ basis[at]

    def products(batches):
        sums = np.zeros((size, width))
        for at, w, y in passages(batches):
            sums[at] += w[:, None] * y
        at = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([x.tobytes() for x in sums[at]], pa.binary())], ["term", "sums"])

    def gram(batches):
        sums = np.zeros((width, width))
        for _, _, y in passages(batches):
            sums += y[:, None] * y
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["term", "sums"])

    def added(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for t, x in zip(batch.column("term").to_pylist(), batch.column("sums").to_pylist()):
                total[t] = total.get(t, 0) + np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["term", "sums"])

    basis = None
    for step in (products, products, gram):
        shared = spark.sparkContext.broadcast((terms, idf, basis))
        table = items.select("text").coalesce(PARTS).mapInArrow(step, "term long, sums binary").repartition("term").mapInArrow(added, "term long, sums binary").toArrow()
        shared.unpersist()
        found = np.frombuffer(b"".join(table["sums"].to_pylist())).reshape(-1, width)
        if step is products:
            basis = np.zeros((size, width))
            basis[table["term"].to_numpy()] = found
            basis = np.linalg.qr(basis)[0]
    squares, turn = np.linalg.eigh(found)
    squares = np.maximum(squares[::-1], 0)
    stay = min(rank, 1 + int(np.searchsorted(np.cumsum(squares), ENERGY * squares.sum())))
    return (basis @ turn[:, ::-1][:, :stay]).astype(np.float32), np.sqrt(squares[:stay])


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, a word of bits for each word of ``b``."""
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & places.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _runs(ids: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` terms from each place on, in one number; 0 where one is no term."""
    out = ids[: max(0, len(ids) - length + 1)].astype(np.uint64)
    whole = out > 0
    for k in range(1, length):
        more = ids[k : k + len(out)]
        out |= more.astype(np.uint64) << np.uint64(21 * k)
        whole &= more > 0
    return np.where(whole, out, 0)


class _Runs:
    """Runs of the items, each of RUN terms or of a shorter item's, and the items that have them."""

    def __init__(self, items: list[np.ndarray]):
        self.by_length = []
        for length in range(1, RUN + 1):
            pairs = [(int(run), k) for k, ids in enumerate(items) if min(len(ids), RUN) == length for run in np.unique(_runs(ids, length))]
            if pairs:
                keys = np.array([run for run, _ in pairs], np.uint64)
                order = np.argsort(keys, kind="stable")
                maybe = np.zeros(1 << 20, bool)
                maybe[self._place(keys)] = True
                self.by_length.append((length, keys[order], np.array([k for _, k in pairs])[order], maybe))

    @staticmethod
    def _place(runs: np.ndarray) -> np.ndarray:
        return (runs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def found(self, ids: np.ndarray) -> set[tuple[int, int]]:
        """(half passage, item) of each run of an item."""
        out = set()
        for length, keys, owner, maybe in self.by_length:
            runs = _runs(ids, length)
            at = np.flatnonzero(maybe[self._place(runs)] & (runs > 0))
            low, high = np.searchsorted(keys, runs[at]), np.searchsorted(keys, runs[at], "right")
            for i in np.flatnonzero(high > low):
                out.update((int(at[i]) // HALF, int(k)) for k in owner[low[i] : high[i]])
        return out


class Matcher:
    """Items of one block with what the search needs; broadcast to the workers.

    Items are given as numbers of terms; ``idf`` and ``basis`` have a row for each term, and an empty row 0.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], idf: np.ndarray, basis: np.ndarray):
        self.names, self.items = [i for i, _ in items], [ids for _, ids in items]
        self.idf, self.weighted = idf, basis * idf[:, None]
        parts = [(k, *_unit(part, idf)) for k, ids in enumerate(self.items) for part in _item_passages(ids)]
        self.owner = np.array([k for k, _, _ in parts], np.int64)
        self.peaks = np.zeros((len(idf), -(-len(parts) // GROUP)), np.float32)  # of each term, the most that it weighs in a group
        vectors = []
        for n, (_, at, w) in enumerate(parts):
            self.peaks[at, n // GROUP] = np.maximum(self.peaks[at, n // GROUP], w)
            latent = w @ basis[at]
            vectors.append(latent / max(float(latent @ latent), 1e-9))
        self.peaks *= idf[:, None]
        self.vectors = np.array(vectors, np.float32)
        self.counts = [Counter(ids.tolist()) for ids in self.items]
        self.runs = _Runs(self.items)
        self.known = min(KNOWN, *(int(np.ceil(PROVED * len(ids))) for ids in self.items))

    @staticmethod
    def _sums(table: np.ndarray, halves: np.ndarray) -> np.ndarray:
        """Sum of the table's rows over each row of HALF terms; few at a time stay in the cache."""
        out = np.empty((len(halves), table.shape[1]), np.float32)
        for at in range(0, len(halves), 64):
            table[halves[at : at + 64]].sum(1, out=out[at : at + 64])
        return out

    def _near(self, halves: np.ndarray) -> dict[tuple[int, int], float]:
        """The cosine of (half passage, item) where it is NEAR or more; a passage is a row of ``halves`` and the next."""
        out: dict[tuple[int, int], float] = {}
        known, w = (halves > 0).sum(1), self.idf[halves]
        norm = np.einsum("ij,ij->i", w, w)
        # a term that repeats counts less here than in the true norm: no candidate is lost
        norm = np.maximum(np.sqrt(norm[:-1] + norm[1:]), 1e-6)
        maybe = known[:-1] + known[1:] >= self.known
        for at in range(0, len(norm), 4096):
            most = self._sums(self.peaks, halves[at : at + 4097])
            maybe[at : at + 4096] &= (most[:-1] + most[1:]).max(1) >= 0.999 * NEAR * norm[at : at + 4096]
        open_ = np.flatnonzero(maybe)
        for at in range(0, len(open_), 2048):
            here = open_[at : at + 2048]
            used = np.unique(np.r_[here, here + 1])
            of = self._sums(self.weighted, halves[used])
            cosines = (of[np.searchsorted(used, here)] + of[np.searchsorted(used, here + 1)]) @ self.vectors.T / norm[here, None]
            rows, columns = np.nonzero(cosines >= NEAR)
            for p, k, x in zip(here[rows].tolist(), self.owner[columns].tolist(), cosines[rows, columns].tolist()):
                out[p, k] = max(out.get((p, k), 0.0), min(x, 1.0))
        return out

    def _cosine(self, halves: np.ndarray, passage: int, item: int) -> float:
        part = halves[passage : passage + 2]
        latent = self._sums(self.weighted, part).sum(0)
        return float(np.clip((self.vectors[self.owner == item] @ latent).max() / max(float(np.sqrt((self.idf[part] ** 2).sum())), 1e-6), 0, 1))

    def _around(self, ids: np.ndarray, item: int, passage: int, last: int) -> list[int]:
        """The words from ``passage`` to ``last`` with as many around as the item has."""
        n = len(self.items[item])
        return ids[max(0, passage * HALF - n) : last * HALF + PASSAGE + n].tolist()

    def _verified(self, ids: np.ndarray, item: int, passage: int) -> tuple[float, bool] | None:
        """Share of the item's words found in order around a passage and whether its answer is there; None if they prove nothing."""
        own, counts = self.items[item], self.counts[item]
        part = self._around(ids, item, passage, passage)
        if sum(map(counts.__getitem__, counts.keys() & set(part))) < LIKELY * len(own):
            return None  # no longer subsequence either
        share = common_subsequence(own.tolist(), part) / len(own)
        answer = own[-ANSWER:].tolist()
        told = any(part[i : i + len(answer)] == answer for i, w in enumerate(part) if w == answer[0])
        return (share, told) if share >= PROVED or share >= LIKELY and told else None

    def _most(self, ids: np.ndarray, item: int, passages: list[int], best: tuple) -> tuple:
        """(share, answer found, passage) of the first of ``passages`` that proves most; ``best`` if none proves more.

        No window has a longer subsequence than one that it lies in, so passages close together are asked at once first:
        a text that has much of a long item is compared a few times, not at each of its places.
        """
        if not passages or best[0] >= 1:
            return best
        if len(passages) == 1:
            found = self._verified(ids, item, passages[0])
            return (*found, passages[0]) if found and found[0] > best[0] else best
        own = self.items[item]
        alone = min(len(ids), 2 * len(own) + PASSAGE)
        reach = min(len(ids), (passages[-1] - passages[0]) * HALF + 2 * len(own) + PASSAGE)
        if 2 * reach <= len(passages) * alone:
            share = common_subsequence(own.tolist(), self._around(ids, item, passages[0], passages[-1])) / len(own)
            if share <= best[0] or share < LIKELY:
                return best
        half = len(passages) // 2
        return self._most(ids, item, passages[half:], self._most(ids, item, passages[:half], best))

    def search(self, held: list[np.ndarray], first: np.ndarray, flat: np.ndarray) -> Iterator[tuple[int, int, float, float, bool]]:
        """(place of the text, item id, cosine, share of the item's words found in order, answer found) of each proved item."""
        halves = flat.reshape(-1, HALF)
        near = self._near(halves)
        best: dict[tuple[int, int], tuple[float, float, bool]] = {}
        for chosen in (list(near), sorted(x for x in self.runs.found(flat) if x not in near)):
            places: dict[tuple[int, int], list[int]] = {}
            for (p, k), t in zip(chosen, (np.searchsorted(first, [p for p, _ in chosen], "right") - 1).tolist()):
                places.setdefault((t, k), []).append(p - int(first[t]))
            for (t, k), of in places.items():
                was = best.get((t, k), (0.0, 0.0, False))
                found = self._most(held[t], k, of[1:], self._most(held[t], k, of[:1], (was[1], was[2], None)))
                if found[2] is not None:
                    p = found[2] + int(first[t])
                    best[t, k] = (near[p, k] if (p, k) in near else self._cosine(halves, p, k), *found[:2])
        return ((t, self.names[k], *v) for (t, k), v in sorted(best.items()))


def leaks(column: list[bytes], terms: dict[bytes, int], blocks: list[Matcher]) -> Iterator[tuple[int, int, float, float, bool]]:
    """(place in ``column``, item id, cosine, share, answer found) of each item that a block proves."""
    held: list[np.ndarray] = []
    start = size = 0
    for n, text in enumerate(column):
        held.append(_ids(_words(text), terms))
        size += len(held[-1])
        if size > AT_ONCE or n == len(column) - 1:
            first = np.r_[0, np.cumsum([len(x) // HALF + 1 for x in held])]  # a text ends with an empty place at least
            flat = np.zeros((first[-1] + 1) * HALF, np.int32)
            for at, x in zip(first.tolist(), held):
                flat[at * HALF : at * HALF + len(x)] = x
            for block in blocks:
                yield from ((start + t, *rest) for t, *rest in block.search(held, first, flat))
            held, start, size = [], n + 1, 0


def _passage_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(_item_passages(np.array(_words(x)))) for x in texts(batch.column("text"))], pa.int64())], ["c"])


def matchers(docs: DataFrame, benchmark: DataFrame) -> Iterator[tuple[dict[bytes, int], list[Matcher]]]:
    """The terms and matchers of TOGETHER blocks of items at once; the blocks grow in number with the items, not in size."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    blocks = -(-(items.select("text").mapInArrow(_passage_counts, "c long").agg(F.sum("c")).first()[0] or 0) // BLOCK)
    for start in range(0, blocks, TOGETHER):
        parts = [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) for k in range(start, min(blocks, start + TOGETHER))]
        held = [[(i, words) for i, text in sorted(map(tuple, part.collect())) if (words := _words(text.encode()))] for part in parts]
        terms = {w: i for i, w in enumerate(sorted({w for block in held for _, words in block for w in words}), 1)}
        if terms:
            idf = weights(docs, terms)
            numbered = [[(i, _ids(words, terms)) for i, words in block] for block in held]
            rank = lambda block: sum(len(_item_passages(ids)) for _, ids in block)
            yield terms, [Matcher(block, idf, latent_space(part, terms, idf, rank(block))[0]) for part, block in zip(parts, numbered) if block]


def _searched(slim: DataFrame, group: tuple[dict[bytes, int], list[Matcher]], answer: Callable, schema) -> DataFrame:
    """``answer(batch, found)`` of each batch, found being what the group proves of its column text."""
    shared = slim.sparkSession.sparkContext.broadcast(group)
    at = slim.columns.index("text")

    def run(batches):
        for batch in batches:
            yield answer(batch, list(leaks(texts(batch.column(at)), *shared.value)))

    return slim.mapInArrow(tidy(run), schema)


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_found: the items that each contaminated document holds.

    A null or empty text holds none; a very long one is searched whole.  Repeated rows give repeated results,
    as does a document that holds several items; of an item's places in a text the one with the most of it
    counts, the first of equal ones.  Items without id or text are left out; several texts of one item_id are
    searched each.  Empty tables give an empty result; other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer_found boolean"

    def rows(batch, found):
        ids = batch.column("doc_id").take(pa.array([x[0] for x in found], pa.int64()))
        return pa.RecordBatch.from_arrays([ids, *(pa.array([x[j] for x in found], t) for j, t in enumerate((pa.int64(), pa.float64(), pa.float64(), pa.bool_()), 1))], ["doc_id", "item_id", "cosine", "lcs_share", "answer_found"])

    out = docs.sparkSession.createDataFrame([], schema)
    for group in matchers(docs, benchmark):
        out = out.unionByName(_searched(slim, group, rows, schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item.

    Null and empty texts and rows without doc_id stay, repeated rows stay or go alike; columns keep their names, types and order.
    """

    def clean(batch, found):
        stay = np.ones(batch.num_rows, bool)
        stay[[x[0] for x in found]] = False
        return batch.filter(pa.array(stay))

    out = docs.toDF(*("text" if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)))
    for group in matchers(docs, benchmark):
        out = _searched(out, group, clean, out.schema)
    return out.toDF(*docs.columns)
