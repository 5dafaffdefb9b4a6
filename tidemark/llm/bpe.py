"""Byte-pair encoding by a deterministic automaton over tokens.

The automaton accepts exactly the correct tokenizations.  It starts as one state with a loop for
every byte; each merge (u, v), in order, adds its gadget: after u the arc v goes (its target is
split off as a state without that arc), and where u and then v could be read an arc uv is added.
All arcs with one label enter one state, so a state is kept as the set of arcs it lacks and the
table of transitions as the state that each label enters.  A word's tokenization is its only
accepted spelling, found by reading labels and stepping back where an arc is missing.

Most rows of bits are alike in most places, so what is kept of them is their different pages and, for
each state, which pages are its own.  The automaton travels packed and a task opens it for itself: a
worker that waits for other stages holds no more than the packed form.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import release, tidy

#: Distinct words whose ids a task remembers (once more as many of those before), and the longest such word.
REMEMBERED, LONG = 100_000, 64
#: Bits of a page's number of bytes.
PAGE = 6
#: First bytes of a token by which the length of what may follow is known.
START = 5
#: The pattern of the byte-level pre-tokenizer, in its public form.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: No match of the pattern goes from a character that is no white space over a space to another.
_apart = re.compile(r" (?<=\S )(?=\S)").split


class _Remembered(dict):
    """What ``make`` gives for a key; the latest keys are remembered, those used again for longer."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.before.pop(key, None)
        if value is None:
            value = self.make(key)
            if len(key) > LONG:
                return value
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _checked(spec: dict) -> dict:
    """``spec``, if this automaton encodes as it says; else an error that names what it can't."""
    plain = {"dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k, v in plain.items() if (model.get(k) or v) != v]
    odd += [k for k, v in {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}.items() if split.get(k, v if k == "use_regex" else None) != v]
    odd += ["normalizer"] * bool(spec.get("normalizer")) + [f"added token {x['content']!r}" for x in spec["added_tokens"] if x.get("single_word") or x.get("lstrip") or x.get("rstrip") or not x.get("special")]
    if model.get("type", "BPE") != "BPE" or odd:
        raise ValueError(f"not a plain byte-level BPE vocabulary: {', '.join(odd) or model['type']}")
    return spec


class TokenAutomaton:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = _checked(json.load(file))
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.ids = vocab
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self._compile([(vocab[raw(a)], vocab[raw(b)], vocab[raw(a) + raw(b)]) for a, b in merges], [vocab[bytes([b])] for b in range(256)], max(i for i in (*vocab.values(), *self.special.values())) + 1)
        self._ready()

    def _ready(self) -> None:
        """What follows from the vocabulary."""
        known = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.labels = [known.get(i, b"") for i in range(max(known) + 1)]
        code = lambda token: np.array([token], "<u4").tobytes()
        # of each token that is read: its code, the state it enters, and where a state's pages say that they lack it
        self.arcs = {t: (code(i), self.enters[i], i >> PAGE + 3, i >> 3 & (1 << PAGE) - 1, 1 << (i & 7)) for t, i in self.ids.items() if i in self.enters}
        self.longest: dict[bytes, int] = {}  # bytes of the longest token that begins with these START
        for t in self.arcs:
            if len(t) >= START:
                self.longest[t[:START]] = max(len(t), self.longest.get(t[:START], 0))
        self.codes = {t: code(i) for t, i in self.special.items()}
        rest = _Remembered(lambda word: self.spell(word.encode()))

        def after_space(chunk: str) -> bytes:
            first, *more = self._find(f" {chunk}")
            return spaced[first[1:]] + b"".join([rest[x] for x in more]) if more else self.spell(first.encode())

        self._spaced = spaced = _Remembered(after_space)  # what follows a space, up to the next
        self._rest = rest
        special = "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))
        self._special = regex.compile(f"({special})") if special else None
        self._find = regex.compile(PATTERN).findall

    def packed(self) -> tuple[bytes, ...]:
        return pickle.dumps((self.special, self.ids, self.enters)), zstandard.compress(self.pages, 3), zstandard.compress(self.places.tobytes(), 3)

    @classmethod
    def unpacked(cls, small: bytes, pages: bytes, places: bytes) -> TokenAutomaton:
        out = cls.__new__(cls)
        out.special, out.ids, out.enters = pickle.loads(small)
        out.pages, out.places = zstandard.decompress(pages), array("I", zstandard.decompress(places))
        out._ready()
        return out

    def _compile(self, merges, alphabet, size: int) -> None:
        """Apply the gadget of every merge; a state is a row of bits, set for the arcs it lacks."""
        width = (size - 1 >> PAGE + 3) + 1 << PAGE
        lacks, n = np.zeros((1024, width), np.uint8), 1
        enters = dict.fromkeys(alphabet, 0)
        shared = {0: len(alphabet)}  # state -> labels that enter it
        for u, v, uv in merges:
            target, after = enters[u], enters[v]
            if lacks[target, v >> 3] >> (v & 7) & 1:
                continue  # never read in this order
            if shared[target] > 1 or target == after:
                if n == len(lacks):
                    lacks = np.concatenate([lacks, np.zeros_like(lacks)])
                shared[target] -= 1
                lacks[n] = lacks[target]
                enters[u], target = n, n
                shared[n] = 1
                n += 1
            lacks[target, v >> 3] |= 1 << (v & 7)
            enters[uv] = after
            shared[after] = shared.get(after, 0) + 1
            lacks[:n, uv >> 3] |= (lacks[:n, u >> 3] >> (u & 7) & 1) << (uv & 7)  # what can't read u can't read uv
        used = sorted({0, *enters.values()})
        pages, places = np.unique(lacks[used].reshape(-1, 1 << PAGE).view(f"V{1 << PAGE}"), return_inverse=True)
        self.pages, self.places = pages.tobytes(), array("I", (places.ravel() << PAGE).astype(np.uint32).tobytes())
        place = {state: i * (width >> PAGE) for i, state in enumerate(used)}  # the place of its first page names a state
        self.enters = {label: place[state] for label, state in enters.items()}

    def spell(self, word: bytes) -> bytes:
        """Codes of the accepted spelling of one pre-split word, four bytes each."""
        n, arcs, longest, pages, places = len(word), self.arcs, self.longest, self.pages, self.places
        path: list[tuple[bytes, int, int]] = []  # (code, start, state before)
        at, state = 0, 0
        dead: set[tuple[int, int]] = set()
        while at < n:
            stop = at + longest.get(word[at : at + START], START - 1)
            if stop > n:
                stop = n
            while stop > at:
                arc = arcs.get(word[at:stop])
                if arc is not None:
                    code, to, page, byte, bit = arc
                    if not pages[places[state + page] + byte] & bit and (not dead or (stop, to) not in dead):
                        break
                stop -= 1
            if stop > at:
                path.append((code, at, state))
                at, state = stop, to
            else:
                dead.add((at, state))
                _, at, state = path.pop()
        return b"".join([code for code, _, _ in path])

    def encode(self, text: str) -> np.ndarray:
        out: list[bytes] = []
        for i, part in enumerate(self._special.split(text) if self._special else [text]):
            if i % 2:
                out.append(self.codes[part])
            elif part:
                first, *rest = _apart(part)
                out += [self._rest[x] for x in self._find(first)]
                out += map(self._spaced.__getitem__, rest)
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: list[int]) -> str:
        labels = self.labels
        return b"".join([labels[i] for i in ids]).decode("utf-8", "replace")


class _Packed:
    """What is broadcast."""

    def __init__(self, path: str):
        self.parts = TokenAutomaton(path).packed()

    def opened(self) -> TokenAutomaton:
        return TokenAutomaton.unpacked(*self.parts)


_compiled: dict[str, _Packed] = {}


def _shared(df: DataFrame, path: str):
    """The automaton of a file, compiled once on the driver; its size is the vocabulary's."""
    if path not in _compiled:
        _compiled[path] = _Packed(path)
        release()
    return df.sparkSession.sparkContext.broadcast(_compiled[path])


def _encoded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.opened()
        for batch in batches:
            lengths, ids_sha, text_sha = [], [], []
            for text in batch.column("text").to_pylist():
                ids = model.encode(text or "")
                lengths.append(len(ids))
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(model.decode(ids.tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return tidy(run)


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of ``docs``.

    A null or empty text has no tokens.  Repeated rows and rows without doc_id stay; an empty table
    gives an empty result; other columns are ignored.  A text of any length is encoded whole, at once.  Only
    the driver reads the vocabulary file.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoded(_shared(docs, path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _id_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.opened()
        for batch in batches:
            ids = [model.encode(x or "") for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return tidy(run)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of each row; a null text has no ids."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_id_rows(_shared(docs, path)), "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text of each row of (doc_id, ids); null ids spell the empty text."""

    shared = _shared(ids, path)

    def run(batches):
        model = shared.value.opened()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([model.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(tidy(run), "doc_id long, text string")
