"""Quality rules whose thresholds follow each language and source.

Fixed base rules come first.  What passes them feeds mergeable quantile sketches (Greenwald-Khanna
summaries) by language and source; a document is kept unless one of its measures lies beyond the
fences that the joined quartiles of its group set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import keep
from tidemark.llm.words import grams, hashed, texts, tidy

#: The characters that count as symbols, and white space.
SYMBOLS, SPACE = b"#*$%&|<>", b" \t\n\v\f\r"
#: Relative precision of the sketches (1 / rank error), and how many quartile distances a fence stands off.
PRECISION, REACH = 2000, 3.0
#: What a measure may exceed its fence by, so that a group without spread rejects nothing ordinary.
SLACK = {"symbols": 0.1, "repeats": 0.2, "dup_lines": 0.2, "word_length": 1.5}


def measures(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    words = text.split()
    n = len(words)
    solid = text.translate(None, SPACE)
    chars = len(solid.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    repeats = 0
    if n > 2:
        g = grams(hashed(words), 3)
        _, which, counts = np.unique(g, return_inverse=True, return_counts=True)
        if len(counts) < len(g):
            twice = counts[which] > 1
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : k + len(g)] |= twice
            repeats = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, len(lines)


#: Groups whose sketches (some 200 bytes each) are broadcast; with more of them the join deals out both sides.
GROUPS = 50_000

_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([measures(x) for x in texts(batch.column("text"))], np.int64).reshape(-1, 6)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(found[:, i]) for i in range(6))], ["doc_id", "lang", "source", *_COLUMNS, "n_lines"])


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for each row.

    A null or empty text has no words and fails the base rules.  A null lang or source is a group of
    its own; a group whose every text fails them keeps none.  Quartiles are the least values that a quarter and
    three quarters of the group's rows do not exceed, so ties and repeated rows count each.  A very long text is
    measured whole.  Repeated rows and rows without doc_id stay.  An empty table gives an empty result; other
    columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text")
    rows = keep(slim.mapInArrow(tidy(_measured), "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in [*_COLUMNS, "n_lines"])))
    rows = rows.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")).withColumns({
        "symbols": F.col("n_symbols") / F.greatest("word_chars", F.lit(1)), "repeats": F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
        "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), "word_length": F.col("word_chars") / F.greatest("n_words", F.lit(1)),
        "group": F.struct(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("lang"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source")),
    })
    sketches = keep(rows.where("not base_failed").groupBy("group").agg(*(F.percentile_approx(m, [0.25, 0.75], PRECISION).alias(f"q_{m}") for m in SLACK)))
    if sketches.limit(GROUPS + 1).count() <= GROUPS:
        sketches = F.broadcast(sketches)
    inside = F.lit(True)
    for m, slack in SLACK.items():
        low, high = F.col(f"q_{m}")[0], F.col(f"q_{m}")[1]
        inside &= F.col(m) <= high + REACH * (high - low) + slack
        if m == "word_length":
            inside &= F.col(m) >= low - REACH * (high - low) - slack
    return rows.join(sketches, "group", "left").select("doc_id", *_COLUMNS, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))
