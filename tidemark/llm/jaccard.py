"""Set-similarity join of documents by a token-group matrix.

Documents whose shingle sets are equal are one set.  The tokens of a set's prefix name its group:
each token votes for the most central set that has it (the one with most shared prefix tokens), and
the set joins the winner.  The matrix holds, for each group, the union of its members' tokens, as
rows (token, group).  Members that are similar to the centre make up the first components.  Sets of
smaller components are then queries of the groups, in chunks of CHUNK members: the overlap of query
and union bounds every similarity to a member, and only chunks whose bound qualifies are opened
and their members verified.  So sets that lie near each other without a link meet by chunk,
not each by each.

The order of tokens that defines prefixes puts the most frequent ones last; any order gives the
same result, so an approximate list of the frequent ones (FREQUENT at most) is enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.store import keep
from tidemark.llm.words import packed, shingles, texts, tidy, unpacked

#: Tokens that the order puts last; the list is broadcast, so this bounds its size.
FREQUENT = 65_536
#: A task reports a token that it saw so often; a sum of so many makes a token frequent.
SEEN, OFTEN = 4, 16
#: Tokens that a task counts exactly before it forgets the rare ones.
COUNTED = 1_000_000
#: Sets in one chunk of a group, and queries that one copy of a chunk answers.
CHUNK, ASKED = 128, 2048


def _key(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(tokens)) - (1 << 63)


def _counts(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(tokens, kind="stable")
    tokens, counts = tokens[order], counts[order]
    first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.empty(0, np.int64)
    return tokens[first], (np.add.reduceat(counts, first) if len(first) else counts)


def _scan(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = [], (np.empty(0, np.int64), np.empty(0, np.int64))
        size = 0

        def merged():
            new = np.concatenate([known[0], *held]) if held else known[0]
            return _counts(new, np.concatenate([known[1], np.ones(len(new) - len(known[0]), np.int64)]))

        for batch in batches:
            ids, n, key = batch.column("doc_id"), [], []
            for text in texts(batch.column("text")):
                s = shingles(text, k)
                n.append(len(s))
                key.append(_key(s) if len(s) else None)
                held.append(s)
                size += len(s)
                if size > COUNTED:
                    known = merged()
                    often = known[1] > 1
                    known, held, size = (known[0][often], known[1][often]), [], 0
            yield _rows(ids, n, key, None)
        known = merged()
        often = known[1] >= SEEN
        tokens, counts = known[0][often], known[1][often]
        for at in range(0, len(tokens), 100_000):
            t = tokens[at : at + 100_000]
            yield _rows(None, None, t, counts[at : at + 100_000])

    return run


def _rows(ids, n, key, seen) -> pa.RecordBatch:
    count = len(key)
    column = lambda x: pa.nulls(count, pa.int64()) if x is None else x.cast(pa.int64()) if isinstance(x, pa.Array) else pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays([column(x) for x in (ids, n, key, seen)], ["doc_id", "n", "key", "seen"])


def _prefixes(k: int, percent: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = frequent.value
        done: set[int] = set()
        for batch in batches:
            tokens, keys, sizes = [], [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text"))):
                s = shingles(text, k)
                n = len(s)
                if i is None or n * (100 - percent) < percent:  # so small a set is similar to none but its equals
                    continue
                if (key := _key(s)) in done:
                    continue
                done.add(key)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    s = s[np.argsort(np.where(common[at] == s, rank[at], 0), kind="stable")]
                s = s[: n - (percent * n + 99) // 100 + 1]
                tokens.append(s)
                keys.append(np.full(len(s), key, np.int64))
                sizes.append(np.full(len(s), n, np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, keys, sizes)], ["token", "key", "n"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (token, key, n) sorted by (token, key), the distinct ones whose token has several keys."""
    last, given = None, False  # the last row so far, and whether it was given out
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if last is not None:
            rows = [np.r_[x, y] for x, y in zip(last, rows)]
        t, k = rows[:2]
        new = np.r_[True, (t[1:] != t[:-1]) | (k[1:] != k[:-1])]
        t, k, n = (x[new] for x in rows)
        same = t[1:] == t[:-1]
        out = np.r_[False, same] | np.r_[same, False]
        if last is not None and given:
            out[0] = False
        if len(t) > 1:
            given = bool(same[-1])
        last = [x[-1:] for x in (t, k, n)]
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(t[out]), pa.array(k[out]), pa.array(n[out].astype(np.int32))], ["token", "key", "n"])


def _votes(percent: int):
    """Of rows (token, score, key, n) sorted by token and falling (score, key), a task's votes (key, n, g, n_g, c) for each token's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the token, centre and size of the centre that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            t, k, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            g, of = k[first].copy(), n[first].copy()
            if last is not None and last[0] == t[0]:
                g[0], of[0] = last[1:]
            last = t[-1], g[-1], of[-1]
            run_of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(t)]))
            g, of = g[run_of], of[run_of]
            near = 100 * np.minimum(n, of).astype(np.int64) >= percent * np.maximum(n, of).astype(np.int64)
            columns = [x[near] for x in (k, n, g, of)]
            if near.any():
                table = pa.table([pa.array(x) for x in columns], ["key", "n", "g", "n_g"]).group_by(["key", "n", "g", "n_g"]).aggregate([([], "count_all")])
                yield from table.combine_chunks().to_batches()

    return run


def _true(k: int):
    """Rows (key, text) whose text has that key: rows of one doc_id may differ in text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([_key(shingles(text, k)) == key for key, text in zip(batch.column(0).to_pylist(), unpacked(batch.column(1)))], pa.bool_()))

    return run


def _answers(k: int, percent: int):
    """Of rows (chunk, kind, label, text) sorted by (chunk, kind), members (kind 0) before queries, the links (u, v) of labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, members, index = None, [], None
        for batch in batches:
            chunks, kinds, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            us, vs = [], []
            for i, text in enumerate(unpacked(batch.column(3))):
                if chunks[i] != chunk:
                    chunk, members, index = chunks[i], [], None
                own, tokens = labels[i], shingles(text, k)
                if kinds[i] == 0:
                    members.append((own, tokens))
                    continue
                if not members:
                    continue
                if index is None:
                    of = np.array([x[0] for x in members], np.int64)
                    sizes = np.array([len(x[1]) for x in members], np.int64)
                    held = np.concatenate([x[1] for x in members])
                    order = np.argsort(held, kind="stable")
                    union, start = np.unique(held[order], return_index=True)
                    index = of, sizes, np.repeat(np.arange(len(members)), sizes)[order], union, np.r_[start, len(held)]
                of, sizes, owner, union, start = index
                at = np.searchsorted(union, tokens)
                at = at[union[np.minimum(at, len(union) - 1)] == tokens]
                if 100 * len(at) < percent * len(tokens):  # the bound: no member has more in common
                    continue
                width = start[at + 1] - start[at]
                hits = np.repeat(start[at] - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum())
                both = np.bincount(owner[hits], minlength=len(members))
                for v in np.unique(of[(100 * both >= percent * (sizes + len(tokens) - both)) & (of != own)]):
                    us.append(own)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def _need(u: str, v: str, percent: int) -> str:
    """Tokens that prefixes of similar sets share at least: all that they must have in common but those of one suffix."""
    least = lambda n: f"({percent} * {n} + 99) div 100"
    return f"({percent} * ({u} + {v}) + {99 + percent}) div {100 + percent} - greatest({least(u)}, {least(v)}) + 1"


def _bounded(hits: DataFrame, group: list[str], percent: int) -> DataFrame:
    """Queries u and groups of rows (token, u, n_u, group, lo, hi), where some member of lo to hi tokens may be similar."""
    hits = hits.where(f"100 * hi >= {percent} * n_u and {percent} * lo <= 100 * n_u").groupBy("u", "n_u", *group).agg(F.count("*").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    hits = hits.selectExpr("*", f"greatest(lo, ({percent} * n_u + 99) div 100) as a", f"least(hi, 100 * n_u div {percent}) as b")
    return hits.where(f"c >= least({_need('n_u', 'a', percent)}, {_need('n_u', 'b', percent)}) - 1").select("u", *group)


def _links(asks: DataFrame, members: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Distinct links (u, v) of labels: queries ``asks`` (key, label, chunk) against ``members`` (key, label, chunk).

    ``sets`` (key, text) has compressed texts, smaller by far than the hashes of their shingles.  A key that
    stands there twice only repeats links.

    A chunk with many queries is copied, so that no task answers more than about ASKED of them.
    """
    many = asks.groupBy("chunk").agg(F.ceil(F.count("*") / ASKED).alias("copies")).where("copies > 1")
    asks = asks.join(many, "chunk", "left").select("key", "label", "chunk", F.pmod(F.xxhash64("key"), F.coalesce("copies", F.lit(1))).alias("copy"))
    members = members.join(asks.select("chunk", "copy").distinct(), "chunk")
    rows = members.withColumn("kind", F.lit(0)).unionByName(asks.withColumn("kind", F.lit(1))).join(sets, "key")
    rows = rows.select(F.xxhash64("chunk", "copy").alias("chunk"), "kind", "label", "text")
    return rows.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(tidy(_answers(k, percent)), "u long, v long").distinct()


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id of the graph of links.

    Two documents link when ``100 * |intersection| >= percent * |union|`` of their shingle sets.
    A null or blank text has an empty set, linked with nothing (component_id: its own doc_id).
    A row without doc_id links with nothing and has a null component_id.  Repeated rows stay.
    A very long text counts whole; ties between groups go to the greater key and change no result.
    An empty table gives an empty result; other columns of ``docs`` are ignored, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = keep(docs.mapInArrow(tidy(_scan(k)), "doc_id long, n long, key long, seen long"))
    of_docs = scanned.where("seen is null").select("doc_id", "n", "key")
    often = scanned.where("seen is not null").groupBy("key").agg(F.sum("seen").alias("c")).where(F.col("c") >= OFTEN).orderBy(F.desc("c"), "key").limit(FREQUENT).toArrow()
    common = often["key"].to_numpy().astype(np.int64)
    order = np.argsort(common)
    frequent = spark.sparkContext.broadcast((common[order], often["c"].to_numpy().astype(np.int64)[order]))

    prefixes = docs.mapInArrow(tidy(_prefixes(k, percent, frequent)), "token long, key long, n int")
    matrix = keep(prefixes.repartition("token").sortWithinPartitions("token", "key").mapInArrow(tidy(_shared), "token long, key long, n int"))
    reps = of_docs.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))

    # groups around central sets: each token votes for the set of most shared tokens among those that have it
    scored = matrix.withColumn("score", F.count("*").over(Window.partitionBy("key"))).select("token", "score", "key", "n")
    votes = scored.repartition("token").sortWithinPartitions("token", F.desc("score"), F.desc("key")).mapInArrow(tidy(_votes(percent)), "key long, n int, g long, n_g int, c long")
    votes = votes.groupBy("key", "n", "g", "n_g").agg(F.sum("c").alias("c"))
    votes = votes.where(f"key = g or 2 * c >= {_need('n', 'n_g', percent)}")
    chosen = keep(votes.groupBy("key").agg(F.max(F.struct(F.when(F.col("key") == F.col("g"), 0).otherwise(F.col("c")).alias("c"), "g")).alias("best")).select("key", F.col("best.g").alias("g")))
    centres = chosen.where("key <> g").select(F.col("g").alias("key")).distinct().withColumn("centre", F.lit(True))
    marked = chosen.join(centres, "key", "left").select("key", "g", F.expr("key = g and centre is null").alias("alone"))
    placed = keep(matrix.join(marked, "key", "left").select("token", "key", "n", F.coalesce("g", "key").alias("g"), F.coalesce("alone", F.lit(True)).alias("alone")))

    # Sets of groups of several are fetched in any case.  A set alone in its group is fetched if counts of shared
    # prefix tokens allow a link with another group; of two lone sets the lesser key asks, for both.
    several = placed.groupBy("token").agg(F.min("g").alias("a"), F.max("g").alias("b")).where("a < b").select("token")
    shared = placed.join(several, "token", "left_semi")
    cells = shared.groupBy("token", "g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.first("alone").alias("alone"))
    lone = shared.where("alone").select("token", F.col("key").alias("u"), F.col("n").alias("n_u"))
    met = keep(_bounded(lone.join(cells, "token").where("u < g or (u > g and not alone)"), ["g"], percent))
    groups = placed.select("key", "n", "g").distinct()
    mates = groups.where("key <> g").select("key", "g")
    keys = mates.select("key").union(mates.select("g")).union(met.select("u")).union(met.select("g")).distinct()
    wanted = reps.join(keys, "key").select(F.col("rep").alias("doc_id"), "key")
    sets = keep(packed(docs).join(wanted, "doc_id").select("key", "text").mapInArrow(tidy(_true(k)), "key long, text binary"))

    # components of members that are similar to their centres
    near = keep(_links(mates.select("key", F.col("key").alias("label"), F.col("g").alias("chunk")), mates.select(F.col("g").alias("key"), F.col("g").alias("label"), F.col("g").alias("chunk")).distinct(), sets, k, percent))
    first = keep(components(near))
    sized = first.join(first.groupBy("label").agg(F.count("*").alias("size")), "label").withColumnRenamed("node", "key")

    # queries of smaller components against the chunks of groups
    known = groups.join(keys, "key", "left_semi").join(sized, "key", "left").select("key", "g", F.coalesce("label", "key").alias("label"), F.coalesce("size", F.lit(1)).alias("size"))
    known = known.withColumn("linked", F.col("size") > 1)
    parts = known.groupBy("g", "linked").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    known = keep(known.join(parts, ["g", "linked"]).select("key", "label", F.struct("size", "label").alias("rank"), F.xxhash64("g", "linked", F.pmod(F.xxhash64("key"), "parts")).alias("chunk")))
    cells = keep(matrix.join(known, "key"))
    across = cells.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("token")
    cells = cells.join(across, "token", "left_semi")
    have = cells.groupBy("token", "chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rank").alias("top"))
    ask = cells.select("token", F.col("key").alias("u"), F.col("n").alias("n_u"), F.col("rank").alias("rank_u"))
    asked = keep(_bounded(ask.join(have, "token").where("rank_u < top"), ["chunk"], percent))
    late = _links(asked.withColumnRenamed("u", "key").join(known.select("key", "label"), "key"), known.select("key", "label", "chunk"), sets, k, percent)
    merged = components(late).withColumnRenamed("label", "whole")
    parts = first.withColumnRenamed("node", "key").unionByName(known.where("rank.size = 1").select("key", "label"))
    parts = parts.join(merged, parts["label"] == merged["node"], "left").select("key", F.coalesce("whole", "label").alias("label"))

    named = reps.join(parts, "key", "left").select("key", "rep", F.coalesce("label", "key").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_key = named.join(least, "label").select("key", "component_id")
    return of_docs.join(by_key, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that link, directly or not, with one of a smaller doc_id.

    Rows without doc_id stay, as do those of null or blank texts; of rows that share a doc_id all stay or go.
    Columns keep their names, types and order; an empty table gives an empty result.
    """
    gone = jaccard_groups(docs, k, percent).groupBy(F.col("doc_id").alias("gone")).agg(F.max(F.expr("component_id = doc_id")).alias("least")).where("not least").select("gone")
    plain = docs.toDF(*(c if c == "doc_id" else f"_{i}" for i, c in enumerate(docs.columns)))
    return plain.join(gone, F.col("doc_id").cast("long") == F.col("gone"), "left_anti").toDF(*docs.columns)
