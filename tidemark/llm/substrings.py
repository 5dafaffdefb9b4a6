"""Removal of word windows that also start in a document with a smaller doc_id.

Reference shards are the regions of documents that hold the first occurrence of a repeated window.
Each shard becomes a suffix automaton; it is sent to those regions that share a window with it,
which stream through it for their matching statistics (the longest suffix at each word that occurs
in the shard).  Spans matched over at least ``window`` words go.

Candidates come from anchors: of every window the least hash of its half-length n-grams, so equal
windows have equal anchors and only regions around anchors of several documents are looked at.
Regions of the same words are one, whose least document stands for all: a region in a later document goes
whole, and only the least one's windows are looked up, so that a passage of a third of all documents
is one row there.  No row stands for a pair of documents: a window knows its first document only.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.store import keep
from tidemark.llm.words import distinct, grams, hashed, packed, texts, tidy, unpacked

#: Windows that start in one region at most; neighbours overlap by the rest of a window.
REGION = 512
#: Words of all automata that a worker keeps.
AUTOMATA = 200_000


def _anchors(words: list[bytes], window: int) -> np.ndarray:
    """For each window the hash of its anchor (int64)."""
    half = window // 2
    g = grams(hashed(words), half)
    reach = window - half + 1
    if len(g) < reach:
        return np.empty(0, np.int64)
    # the least over a sliding span, by doubling
    least, width = g, 1
    while width * 2 <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    n = len(g) - reach + 1
    return np.minimum(least[:n], least[reach - width : reach - width + n]).view(np.int64)


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, out = [], [], []
            for i, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), texts(batch.column("text"))):
                a = distinct(_anchors(text.split(), window))
                out.append(a)
                ids.append(np.full(len(a), i, np.int64))
                rows.append(np.full(len(a), row, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (out, ids, rows)], ["anchor", "doc_id", "row"])

    return run


def _regions(window: int):
    """Runs of windows whose anchor is shared, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            shared = batch.column("anchors")
            at, flat = shared.offsets.to_numpy(), shared.values.to_numpy(zero_copy_only=False)
            for j, (i, row, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), unpacked(batch.column("text")))):
                words = text.split()
                hit = np.isin(_anchors(words, window), flat[at[j] : at[j + 1]])
                if not hit.any():
                    continue
                edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
                for a, b in zip(edges[::2], edges[1::2]):
                    for lo in range(a, b, REGION):
                        hi = min(b, lo + REGION)
                        out.append((i, row, int(lo), b" ".join(words[lo : hi + window - 1])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3].decode() for x in out], pa.string())],
                ["doc_id", "row", "start", "words"],
            )

    return run


def _windows(window: int):
    """The hash of each different window of a region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [distinct(grams(hashed(x.split()), window).view(np.int64)) for x in texts(batch.column("words"))]
            n = [len(x) for x in hashes]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(hashes) if hashes else np.empty(0, np.int64)), *(pa.array(np.repeat(batch.column(c).to_numpy(), n)) for c in ("doc_id", "start"))],
                ["hash", "doc_id", "start"],
            )

    return run


def _routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (hash, doc_id, start): each later document's region and the first region, once a batch."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, d, s = (batch.column(c).to_numpy() for c in ("hash", "doc_id", "start"))
        new = np.r_[last is None or h[0] != last[0], h[1:] != h[:-1]]
        at = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        to_d, to_s = d[at], s[at]
        if not new[0]:
            to_d, to_s = np.where(at < 0, last[1], to_d), np.where(at < 0, last[2], to_s)
        last = h[-1], to_d[-1], to_s[-1]
        later = d > to_d
        if later.any():
            rows = np.unique(np.stack([d, s, to_d, to_s])[:, later], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["doc_id", "start", "first_id", "first_start"])


class SuffixAutomaton:
    """Of a sequence of words: every path from state 0 spells a run of them."""

    def __init__(self, words: list[bytes]):
        self.next, self.link, self.length = [{}], [-1], [0]
        last = 0
        for word in words:
            new = self._state({}, 0, self.length[last] + 1)
            at = last
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = new
                at = self.link[at]
            if at >= 0:
                to = self.next[at][word]
                if self.length[to] == self.length[at] + 1:
                    self.link[new] = to
                else:
                    twin = self._state(dict(self.next[to]), self.link[to], self.length[at] + 1)
                    while at >= 0 and self.next[at].get(word) == to:
                        self.next[at][word] = twin
                        at = self.link[at]
                    self.link[to] = self.link[new] = twin
            last = new

    def _state(self, following: dict, link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def statistics(self, words: list[bytes]) -> list[int]:
        """For each word the length of the longest run ending there that occurs in the automaton's words."""
        state = matched = 0
        out = []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            to = self.next[state].get(word)
            if to is None:
                state = matched = 0
            else:
                state, matched = to, matched + 1
            out.append(matched)
        return out


class _Automata(OrderedDict):
    words = 0

    def of(self, text: str) -> SuffixAutomaton:
        if text in self:
            self.move_to_end(text)
            return self[text][0]
        words = text.encode().split()
        self[text] = found = SuffixAutomaton(words), len(words)
        self.words += len(words)
        while self.words > AUTOMATA and len(self) > 1:
            self.words -= self.popitem(last=False)[1][1]
        return found[0]


def _matched(window: int):
    """Covered spans [from, to) of a region's words, for each region and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _Automata()
        for batch in batches:
            keys, spans = [], []
            for key, text, shard in zip(*(batch.column(c).to_pylist() for c in ("key", "words", "shard"))):
                ends = [e for e, m in enumerate(automata.of(shard).statistics(text.encode().split())) if m >= window]
                found = []
                for e in ends:
                    a, b = e - window + 1, e + 1
                    if found and a <= found[-1]:
                        found[-1] = b
                    else:
                        found += [a, b]
                if found:
                    keys.append(key)
                    spans.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(spans, pa.list_(pa.int64()))], ["key", "spans"])

    return run


def repeated_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, row, spans): word positions [from, to), as a flat list for each region and shard, of what repeats an earlier document.

    ``docs`` has doc_id (not null), row (a hash of the text) and text.
    """
    key = ["doc_id", "row"]
    anchors = docs.mapInArrow(tidy(_anchor_rows(window)), "anchor long, doc_id long, row long")
    anchors = keep(anchors.repartition("anchor").sortWithinPartitions("anchor", "doc_id").mapInArrow(tidy(_several), "anchor long, doc_id long, row long"))
    shared = anchors.groupBy(*key).agg(F.collect_set("anchor").alias("anchors"))  # no more than the document has words
    regions = keep(packed(docs).join(shared, key).mapInArrow(tidy(_regions(window)), "doc_id long, row long, start long, words string").withColumn("key", F.md5("words")))
    heads = regions.groupBy("key").agg(F.min("doc_id").alias("head"))
    placed = regions.join(heads, "key")
    one = F.min(F.struct("row", "start")).alias("one")  # a document may have a region twice
    chosen = placed.where("doc_id = head").groupBy("key", "doc_id").agg(one).select("key", "doc_id", "one.row", "one.start")
    classes = keep(regions.join(chosen, ["key", "doc_id", "row", "start"], "left_semi").select("key", "doc_id", "start", "words"))
    windows = classes.mapInArrow(tidy(_windows(window)), "hash long, doc_id long, start long")
    routes = windows.repartition("hash").sortWithinPartitions("hash", "doc_id", "start").mapInArrow(tidy(_routes), "doc_id long, start long, first_id long, first_start long").distinct()
    shards = classes.select(F.col("doc_id").alias("first_id"), F.col("start").alias("first_start"), F.col("words").alias("shard"))
    pairs = routes.join(shards, ["first_id", "first_start"]).join(classes, ["doc_id", "start"])
    matched = pairs.select("key", "words", "shard").mapInArrow(tidy(_matched(window)), "key string, spans array<long>")
    of_heads = placed.where("doc_id = head").select("key", *key, "start").join(matched, "key").select(*key, F.expr("transform(spans, x -> x + start)").alias("spans"))
    size = F.size(F.split("words", " "))
    whole = placed.where("doc_id > head").select(*key, F.array(F.col("start"), F.col("start") + size).cast("array<long>").alias("spans"))
    return of_heads.unionByName(whole)


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (anchor, doc_id), those whose anchor has several documents."""
    held: pa.RecordBatch | None = None  # rows of the last anchor, while they have one document
    several = None  # the last anchor, if it has several
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            held = None
        if not batch.num_rows:
            continue
        a, d = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        ends = np.r_[first[1:], len(a)]
        many = d[first] != d[ends - 1]
        if several is not None and a[0] == several:
            many[0] = True
        out = np.repeat(many, ends - first)
        if many[-1]:
            several = a[-1]
        else:
            held = batch.slice(int(first[-1]))
            several = None
        if out.any():
            yield batch.filter(pa.array(out))


def _left(text: bytes, spans) -> tuple[int, list[bytes]]:
    """The number of words, and the words that stay."""
    words = text.split()
    if not spans:
        return len(words), words
    stay = np.ones(len(words), bool)
    for span in spans:
        for a, b in zip(span[::2], span[1::2]):
            stay[a:b] = False
    return len(words), [w for w, s in zip(words, stay) if s]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_left(*x) for x in zip(unpacked(batch.column("text")), batch.column("spans").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([n - len(x) for n, x in found], pa.int64()), pa.array([hashlib.sha256(b" ".join(x)).hexdigest() for _, x in found], pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, cut = [], []
        for was, text, spans in zip(batch.column("text").is_valid().to_pylist(), unpacked(batch.column("text")), batch.column("spans").to_pylist()):
            cut.append(bool(spans))
            out.append(None if not was else (b" ".join(_left(text, spans)[1]) if spans else text).decode())
        yield pa.RecordBatch.from_arrays([batch.column("all"), pa.array(out, pa.string()), pa.array(cut, pa.bool_())], ["all", "text", "cut"])


def _with_spans(docs: DataFrame, window: int) -> DataFrame:
    """``docs`` (with the column row) and the spans that go, null where none does."""
    told = docs.where("doc_id is not null and text is not null").select("doc_id", "row", "text")
    spans = repeated_spans(told, window).groupBy("doc_id", "row").agg(F.collect_set("spans").alias("spans"))  # within the document's words
    return packed(docs).join(spans, ["doc_id", "row"], "left")


def removed_substrings(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of ``docs``.

    Each word goes that is covered by a ``window`` of words which also starts in a document of a
    smaller doc_id, judged on the input.  A null or empty text has no words.  A row without doc_id
    neither loses words nor makes others lose them.  Repeated rows stay and lose the same words.
    A very long text is read whole.  An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("text"))
    return _with_spans(rows, window).select("doc_id", "text", "spans").mapInArrow(tidy(_digest), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` with the texts that :func:`removed_substrings` leaves; a text that loses nothing stays as it is.

    n_chars, if there is such a column, is that of the new text.  Rows without doc_id stay as they are, repeated
    rows lose the same; columns keep their names, types and order; an empty table gives an empty result.
    """
    plain = docs.toDF(*("text" if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)))
    rest = [c for c in plain.columns if c != "text"]
    slim = plain.select(F.struct(*rest).alias("all"), F.col(f"_{docs.columns.index('doc_id')}").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("text"))
    joined = _with_spans(slim, window).select("all", "text", "spans")
    schema = T.StructType([joined.schema["all"], T.StructField("text", T.StringType()), T.StructField("cut", T.BooleanType())])
    cut = joined.mapInArrow(tidy(_cut), schema)

    def column(i: int, c: str):
        was = F.col("all")[f"_{i}"]
        return F.col("text") if c == "text" else F.when(F.col("cut"), F.length("text").cast(docs.schema[c].dataType)).otherwise(was) if c == "n_chars" else was

    return cut.select(*(column(i, c).alias(c) for i, c in enumerate(docs.columns)))
