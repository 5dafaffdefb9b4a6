"""Each operator against a plain version on small tables with nulls, empty and repeated texts, ties and extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, shared = text(120), text(70)
    rows = [(0, None), (1, ""), (2, "One two"), (3, "one TWO"), (4, "a b c d"), (5, "a b c d e"), (6, " \n\t "), (7, base), (8, base), (8, base)]
    for i in range(9, 30):
        w = base.split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(i, f"{text(rng.randrange(5, 90))}\n{shared}  {text(rng.randrange(60))}") for i in range(30, 40)]
    return rows + [(i, text(rng.randrange(3, 200))) for i in range(40, 60)] + [(60, text(6000)), (None, base)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, "x", ["en", "de", None][k % 3], ["s", "s", "s", "t", None][k % 5], 7) for k, (i, t) in enumerate(corpus)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, lang string, source string, n long").repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def shingle_set(text, k=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_jaccard_groups(docs, empty, corpus):
    from tidemark.llm.jaccard import jaccard_groups, one_of_each

    sets = [(i, shingle_set(t)) for i, t in corpus if i is not None]
    label = {i: i for i, _ in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                label[y] = x
    want = sorted((i, len(s), top(i)) for i, s in sets)
    got = sorted(tuple(r) for r in jaccard_groups(docs).where("doc_id is not null").select("doc_id", "n_shingles", "component_id").collect())
    assert got == want
    assert jaccard_groups(docs).where("doc_id is null").first()["component_id"] is None
    assert jaccard_groups(empty).count() == 0
    kept = one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {top(i) for i, _ in sets} | {None}


def test_hashes_and_distinct_values():
    import xxhash

    from tidemark.llm import words as w

    made = [b"a", b"bc", b"a", "é".encode(), b"x" * 300]
    assert w.hashed(made).tolist() == [xxhash.xxh3_64_intdigest(x) for x in made] and w.hashed([]).dtype == np.uint64
    assert not any(isinstance(x, dict) and b"bc" in x for x in vars(w).values())  # nothing stays in a worker
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 500):
        values = rng.integers(-9, 9, n) if n < 500 else rng.integers(-1 << 62, 1 << 62, n).repeat(2)
        assert np.array_equal(w.distinct(values), np.unique(values))


def test_substrings(docs, empty, corpus):
    from tidemark.llm.substrings import removed_substrings, without_repeats

    first = {}
    for i, t in corpus:
        w = words(t)
        for k in range(len(w) - 49) if i is not None else ():
            first[tuple(w[k : k + 50])] = min(i, first.get(tuple(w[k : k + 50]), i))
    want = []
    for i, t in corpus:
        w, gone = words(t), set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    got = [tuple(r) for r in removed_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(x[2] for x in want)
    assert removed_substrings(empty).count() == 0
    whole = without_repeats(docs)
    assert whole.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in whole.collect()}
    assert texts[0] is None and texts[6] == " \n\t " and texts[8] == ""


def test_suffix_automaton_statistics():
    from tidemark.llm.substrings import SuffixAutomaton

    rng = random.Random(1)
    a, b = ([rng.choice([b"x", b"y", b"z"]) for _ in range(60)] for _ in range(2))
    runs = {tuple(a[i:j]) for i in range(60) for j in range(i, 61)}
    want = [max(n for n in range(e + 2) if tuple(b[e + 1 - n : e + 1]) in runs) for e in range(60)]
    assert SuffixAutomaton(a).statistics(b) == want


def test_bpe_equals_the_library_and_round_trips(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    from tidemark.llm.bpe import decode, encode, encoded_digests
    from tidemark.llm.queries import vocabulary

    library = tokenizers.Tokenizer.from_file(vocabulary())
    odd = docs.sparkSession.createDataFrame([(100, "aaaa $$$$ <|endoftext|>don't 123\n\n é🎉"), (101, "a" * 5000)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(odd)
    ids = {(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in encoded_digests(rows, vocabulary()).collect()}
    for r in rows.collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["doc_id"], len(want), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest()) in ids
    back = decode(encode(odd, vocabulary()), vocabulary())
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, odd.collect()))
    assert encoded_digests(empty, vocabulary()).count() == 0


def test_bpe_leaves_a_waiting_worker_no_automaton():
    import gc
    import pickle

    import pyarrow as pa

    from tidemark.llm import bpe
    from tidemark.llm.queries import vocabulary

    class Sent:  # as a worker gets it
        value = pickle.loads(pickle.dumps(bpe._Packed(vocabulary())))

    held = lambda: sum(isinstance(x, bpe.TokenAutomaton) for x in gc.get_objects())
    gc.collect()
    before = held()
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one two", None]})
    out = bpe._encoded(Sent)(iter([batch]))
    assert next(out).column("n_tokens").to_pylist()[1] == 0 and held() == before + 1
    assert list(out) == [] and held() == before
    assert before == 0 and len(pickle.dumps(Sent.value)) < 6_000_000
    model = Sent.value.opened()
    assert len(model.pages) + 4 * len(model.places) < 25_000_000


def test_bpe_cuts_only_where_the_pattern_does():
    import regex

    from tidemark.llm import bpe

    find, spaces = regex.compile(bpe.PATTERN).findall, [" ", "  ", "\n", " \n", "\n ", "\t", "\x1c", "\x85 ", " \xa0", "\u3000", " \u200b"]
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice(spaces + ["'s", "a", "B9", "9", "é", "_", "'", "word,", "🎉", "中"]) for _ in range(rng.randrange(1, 12)))
        first, *rest = bpe._apart(text)
        assert [*find(first), *(x for c in rest for x in find(f" {c}"))] == find(text), repr(text)


def test_sharding(docs, empty, corpus):
    from tidemark.llm.sharding import proportional_shards

    rows = proportional_shards(docs, 8).collect()
    assert len(rows) == len(corpus)
    by = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert {(r["doc_id"], r["text_crc32"], r["size"]) for r in rows} == {(i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in corpus}
    of = {i: ["s", "s", "s", "t", None][k % 5] for k, (i, _) in enumerate(corpus)}
    for source in ("s", "t", None):
        shares = [sum(of[r["doc_id"]] == source for r in rows if r["shard"] == s and r["doc_id"] != 8) for s in range(8)]
        assert max(shares) - min(shares) <= 3  # each shard has the whole table's mixture, but for rounding
    again = proportional_shards(docs.repartition(3), 8).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert proportional_shards(empty).count() == 0


def test_quality(docs, empty, corpus):
    from tidemark.llm.quality import quality_verdicts

    got = {(r["doc_id"], r["n_words"], r["n_repeat_words"], r["base_failed"]) for r in quality_verdicts(docs).collect()}
    for i, t in corpus:
        w = words(t)
        runs = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        covered = {k + d for k, run in enumerate(runs) if runs.count(run) > 1 for d in range(3)} if len(w) < 1000 else None
        if covered is not None:
            assert (i, len(w), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)) in got
    assert quality_verdicts(empty).count() == 0


def test_quality_verdicts_against_exact_quartiles(spark):
    from tidemark.llm.quality import REACH, SLACK, quality_verdicts

    rng = random.Random(12)
    rows = []
    for i in range(400):
        w = [rng.choice(["#", "a", "word", "longer", "w" * rng.randrange(1, 30)]) if rng.random() < (i % 40) / 60 else "".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(rng.randrange(40, 120))]
        cut = rng.randrange(1, 9)
        lines = [" ".join(w[k : k + cut]) for k in range(0, len(w), cut)]
        rows.append((i if i % 50 else None, "\n".join(lines + lines[: (i % 25) * (i % 3 == 0)]), rng.choice(["en", "de", None]), rng.choice(["s", "s", "t", None])))
    rows += [(500, None, "en", "s"), (501, "", "en", "s"), (502, "\n ".join(["x y"] * 60), "zz", None)] + rows[7:9]
    found, groups = [], {}
    for i, t, lang, source in rows:
        w = words(t)
        runs = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        covered = {k + d for k, run in enumerate(runs) if runs.count(run) > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        dup, symbols, chars = len(lines) - len(set(lines)), sum(c in "#*$%&|<>" for c in t or ""), sum(map(len, w))
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        m = {"symbols": symbols / max(1, chars), "repeats": len(covered) / max(1, len(w)), "dup_lines": dup / max(1, len(lines)), "word_length": chars / max(1, len(w))}
        found.append(((i, len(w), chars, symbols, dup, len(covered), failed), (lang, source), m))
        if not failed:
            groups.setdefault((lang, source), []).append(m)
    at = lambda values, p: sorted(values)[max(0, -(-int(p * 100) * len(values) // 100) - 1)]

    def inside(m, group):
        for name, slack in SLACK.items():
            low, high = (at([x[name] for x in group], p) for p in (0.25, 0.75))
            if m[name] > high + REACH * (high - low) + slack or name == "word_length" and m[name] < low - REACH * (high - low) - slack:
                return False
        return True

    want = [(*base, not base[-1] and inside(m, groups[g])) for base, g, m in found]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, kept int")
    assert sorted(map(tuple, quality_verdicts(df).collect()), key=str) == sorted(want, key=str)
    assert 5 < sum(not x[-1] and not x[-2] for x in want) < 300


def test_quality_measures():
    from tidemark.llm.quality import measures

    assert measures("é a# b\n\né a# b\n \ta".encode()) == (7, 9, 2, 1, 6, 3)
    assert measures(b"") == (0, 0, 0, 0, 0, 0)


def test_chat(spark):
    from tidemark.llm.chat import preference_parts, preference_turns

    turns = [(1, 0, 0, "user", "hi"), (1, 0, 1, "assistant", "good"), (1, 1, 0, "user", "hi"), (1, 1, 1, "assistant", "bad"), (1, 1, 2, "user", None), (2, 0, 0, "user", "alone"), (None, 0, 0, "user", "x")]
    df = spark.createDataFrame(turns, "pair_id long, side int, turn long, role string, text string")
    got = sorted(tuple(r) for r in preference_turns(df).select("pair_id", "part", "turn", "loss_mask", "rendered").collect())
    assert got == [
        (1, "chosen", 1, 1, "<|assistant|>\ngood<|end|>\n"), (1, "prompt", 0, 0, "<|user|>\nhi<|end|>\n"), (1, "rejected", 1, 1, "<|assistant|>\nbad<|end|>\n"),
        (1, "rejected", 2, 0, "<|user|>\n<|end|>\n"), (2, "chosen", 0, 0, "<|user|>\nalone<|end|>\n"),
    ]
    parts = {(r["pair_id"], r["part"]): (r["n_turns"], r["loss_mask"], r["rendered"]) for r in preference_parts(df).collect()}
    assert parts[1, "rejected"] == (2, "10", "<|assistant|>\nbad<|end|>\n<|user|>\n<|end|>\n") and len(parts) == 4
    assert preference_turns(df.where("false")).count() == preference_parts(df.where("false")).count() == 0


def test_chat_pairs_share_their_longest_prefix(spark):
    from tidemark.llm.chat import contrasted, preference_parts

    rng = random.Random(11)
    rows = []
    for c in range(30):
        roles = ["system"] * rng.randrange(2) + ["user", "assistant"] * rng.randrange(4) + ["user"] * rng.randrange(2)
        rows += [(c, k, role, rng.choice(["yes", "no", None, "", "long " * 3000])) for k, role in enumerate(roles)]
    rows += [(31, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(1000)] + [(None, 0, "user", "x"), (40, None, "user", "x"), (2, 0, rows[0][2], rows[0][3]), (2, 0, rows[0][2], rows[0][3])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, pair_id string")
    by = {}
    for c, turn, role, text in rows:
        if c is not None and turn is not None:
            by.setdefault(c, []).append((turn, role, text))
    last = {c: max(t for t, role, _ in x if role == "assistant") for c, x in by.items() if any(r == "assistant" for _, r, _ in x)}
    show = lambda x: "".join(sorted(f"<|{r}|>\n{t or ''}<|end|>\n" for r, t in x))
    want = {}
    for c, end in last.items():
        other = c ^ 1
        bag = lambda x, k: sorted(((r, t) for n, r, t in x if n == k), key=str)
        chosen = [x for x in by[c] if x[0] <= end]
        rejected = [x for x in chosen if x[0] < end] + [(end, r, t) for n, r, t in by[other] if n == last[other] and r == "assistant"] if other in last else []
        parted = min((k for k in range(end + 1) if bag(chosen, k) != bag(rejected, k)), default=end + 1)
        for part, side, keep in (("prompt", chosen, lambda k: k < parted), ("chosen", chosen, lambda k: k >= parted), ("rejected", rejected, lambda k: k >= parted)):
            text = "".join(show(bag(side, k)) for k in range(end + 1) if keep(k))
            if text:
                want[c, part] = text
    got = {}
    for r in preference_parts(contrasted(df)).orderBy("pair_id", "part", "segment").collect():
        got[r["pair_id"], r["part"]] = got.get((r["pair_id"], r["part"]), "") + r["rendered"]
    assert got == want and sum(part == "prompt" for _, part in want) > 10
    assert contrasted(df.where("false")).count() == 0


def test_pages(spark):
    from tidemark.llm.pages import extracted, main_text

    page = (
        "<html><head><title>T</title><script>var a='</p><p>no';</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav><div class='cookie-notice'>We use cookies</div>"
        "<div id=main><h1>The &eacute;t&#233;</h1><p>First paragraph, with commas, and\n more.<p>Second <b>bold</b> one.</div><div class=sidebar><p>Side, side, side</div>"
        "<div class='comments'><p>Nice, very nice, indeed</div><form><p>Name</p></form><footer>(c)</footer>"
    )
    assert main_text(page) == "The été\nFirst paragraph, with commas, and more.\nSecond bold one."
    df = spark.createDataFrame([(1, "u", page, 3), (2, None, None, 3), (None, "u", "", 3)], "page_id long, url string, html string, n_chars int")
    assert {(r["page_id"], r["n_chars"]) for r in extracted(df).collect()} == {(1, len(main_text(page))), (2, 0), (None, 0)}


def test_pages_in_wrappers_and_in_depth(spark):
    from tidemark.llm.pages import extracted, main_text

    body = "<h1>Head</h1>" + "".join(f"<p>Paragraph {i}, with commas, and more words in it to be long.</p>" for i in range(5))
    want = "Head\n" + "\n".join(f"Paragraph {i}, with commas, and more words in it to be long." for i in range(5))
    side = "<div class=sidebar><p>Side, side, side and more, of it, you know, at some length.</p></div>"
    comments = "<section id=comments>" + "<article class='comment-body'><p>Nice, very nice, indeed, so good, it goes on, and on, and on, yes, yes.</p></article>" * 30 + "</section>"
    for tag in ("article", "div"):
        for name in ("content", "with-sidebar", "no-ads", "page has-sidebar", "legal-analysis"):
            assert main_text(f"<body><nav><a href=x>Home</a></nav><div class='{name}'><{tag}>{body}</{tag}>{side}{comments}</div></body>") == want
    assert main_text("<article><p>We have <math><mi>x</mi></math> and <object>an object</object>, see.</p></article>") == "We have x and an object, see."
    deep = "<div>" * 100_000 + "<p>deep, deep text</p>" + "</section>" * 100_000
    df = spark.createDataFrame([(1, "u", deep), (1, "u", deep), (2, "v", "<p>" + "word, " * 300_000)], "page_id long, url string, html string")
    assert sorted(r["n_chars"] for r in extracted(df).collect()) == [15, 15, 6 * 300_000 - 1]
    assert extracted(df.where("false")).count() == 0


def test_toxicity_on_held_out_rows(spark):
    from tidemark.llm.toxicity import toxicity_scores

    rng = random.Random(2)
    plain = ["river", "stone", "cloud", "garden", "winter", "letter", "bread", "window"]
    text = lambda bad: " ".join(rng.choice(["grumbzot", "vexlurk"]) if bad and k % 15 == 3 else rng.choice(plain) for k in range(40))
    rows = [(i, text(i % 6 == 0), int(i % 6 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity_scores(docs, labels).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert held and sum(p == y for p, y in held) >= 0.97 * len(held)
    assert got[1000]["score"] == got[1001]["score"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity_scores(docs.where("false"), labels.where("false")).count() == 0


def test_toxicity_counts_all_grams_of_a_large_input(spark):
    import numpy as np

    from tidemark.llm import toxicity

    rng = random.Random(9)
    signs = "abcdefghijklmnopqrstuvwxyz0123456789"
    words_ = ["grumbzot", "river", "stone", "vexlurk", "window"]
    rows = [(i, " ".join(rng.choices(words_, k=60)) + " " + "".join(rng.choices(signs, k=14000)), i % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    split = labels.where(~toxicity.held_out()).withColumn("curve", F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(4)) == 0)
    used = {r["doc_id"] for r in split.where("not curve").collect()}
    count = lambda y: np.unique(np.concatenate([np.repeat(g, np.minimum(n, toxicity.PER_TEXT)) for i, t, c in rows if i in used and c in y for g, n in [np.unique(toxicity._packed(t), return_counts=True)]]), return_counts=True)
    toxic, ordinary, types = count({1}), count({0}), count({0, 1})[0]
    assert len(types) > 2_000_000
    d = toxicity.DISCOUNT

    def probability(g, order, kinds, counts, lower):
        inside = kinds >> np.uint64(8) == g >> np.uint64(8)
        total = counts[inside].sum()
        own = counts[kinds == g].sum()
        return (max(own - d, 0) + np.minimum(counts[inside], d).sum() * lower) / total if total else lower

    tables = []
    for order in range(5, 0, -1):
        types, c = np.unique(types & np.uint64((1 << 8 * order) - 1), return_counts=True)
        tables.append((order, types, c))
    text = "the grumbzot river"
    want = []
    for g in toxicity._packed(text):
        p = 1 / 256
        for order, kinds, c in reversed(tables):
            p = probability(g & np.uint64((1 << 8 * order) - 1), order, kinds, c, p)
        want.append(np.log(probability(g, 6, *toxic, p) / probability(g, 6, *ordinary, p)))
    assert np.isclose(model.ratios(text), want, atol=0.02).mean() >= 0.8
    _, pairs, c = tables[3]  # places of pairs don't collide
    after_q = pairs >> np.uint64(8) == ord("q")
    assert np.allclose(model.seen[2][pairs[after_q].astype(int)], np.maximum(c[after_q] - d, 0) / c[after_q].sum(), rtol=0.01)


def test_toxicity_looks_texts_up_together(monkeypatch):
    from tidemark.llm import toxicity

    rng = random.Random(3)
    texts = ["", "a", " ", "Ab é🎉\n", *("".join(rng.choice("abc dE\n") for _ in range(rng.randrange(400))) for _ in range(60)), "x" * 5000]
    grams, counts = np.unique(np.concatenate([toxicity._packed(t) for t in texts]), return_counts=True)
    levels = {}
    for name in ("toxic", "ordinary", *range(toxicity.ORDER - 1, 0, -1)):
        if isinstance(name, int):
            grams, counts = np.unique(grams & np.uint64((1 << 8 * name) - 1), return_counts=True)
        counts = counts + 7 * (name == "toxic")
        contexts, of = np.unique(grams >> np.uint64(8), return_inverse=True)
        kept = counts > toxicity.DISCOUNT
        levels[name] = grams[kept], counts[kept].astype(float), contexts, np.bincount(of, counts).astype(float), np.bincount(of, np.minimum(counts, toxicity.DISCOUNT))
    model = toxicity.ToxicityModel(levels)
    model.weights = np.arange(len(model.weights)) / 10
    calls = []
    looked_up = toxicity.ToxicityModel._ratios
    monkeypatch.setattr(toxicity.ToxicityModel, "_ratios", lambda self, g: calls.append(len(g)) or looked_up(self, g))
    together = model.scores(texts)
    assert len(calls) < len(texts) / 10 and max(calls) <= toxicity.TOGETHER + 5000
    alone = [model.scores([t])[0] for t in texts]
    assert together == alone and len(set(alone)) > 50

    def plainly(text):
        """Character by character from the tables; at a place of ``order`` characters stand what ends there."""
        b, out = [32] * (toxicity.ORDER - 1) + toxicity._LOWER[[c & 255 ^ c >> 8 & 255 for c in map(ord, text)]].tolist(), []
        for end in range(toxicity.ORDER - 1, len(b)):
            code = lambda k, to: sum(b[to - j] << 8 * j for j in range(k))  # noqa: B023, E731
            at = lambda k, to: int(toxicity._slot(np.array([code(k, to)], np.uint64), k, model.bits[k])[0])  # noqa: B023, E731
            p = np.float32(model.seen[1][at(1, end)]) + float(model.rest[1][0]) / 256
            for k in range(2, toxicity.ORDER):
                p = float(model.seen[k][at(k, end)]) + float(model.rest[k][at(k - 1, end - 1)]) * p
            last, before = at(toxicity.ORDER, end), at(toxicity.ORDER - 1, end - 1) if end >= toxicity.ORDER else int(toxicity._slot(np.array([int.from_bytes(b" " * 6, "little")], np.uint64), toxicity.ORDER - 1, model.bits[toxicity.ORDER - 1])[0])
            one = [float(model.seen[c][last]) + float(model.rest[c][before]) * p for c in ("toxic", "ordinary")]
            out.append(np.log(max(one[0], 1e-12) / max(one[1], 1e-12)))
        return out

    for text in texts[:8]:
        assert np.allclose(model.ratios(text), plainly(text), atol=1e-3)


def test_languages_on_held_out_rows(spark):
    from tidemark.llm.langid import predicted_languages

    rng = random.Random(3)
    parts = {"aa": ["the", "and", "ing", "wh"], "bb": ["ung", "sch", "der", "ü"], "cc": ["eau", "é", "que", "tion"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(30)), lang) for i in range(600) for lang in [list(parts)[i % 3]]]
    docs = spark.createDataFrame(rows + [(1000, None, "aa"), (1001, "12 34 !", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in predicted_languages(docs).collect()}
    held = [got[i]["lang_pred"] == lang for i, _, lang in rows if got[i]["held_out"]]
    assert sum(held) >= 0.97 * len(held) and got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und"
    assert predicted_languages(docs.where("false")).count() == 0


def test_leaks(spark, docs, corpus):
    from tidemark.llm.leaks import benchmark_leaks, common_subsequence, without_leaks

    rng = random.Random(6)
    items = [(i, " ".join(f"q{rng.randrange(5000)}" for _ in range(20 + 4 * i))) for i in range(8)]
    benchmark = spark.createDataFrame(items + [(9, None)], "item_id long, text string")
    planted = [(200 + i, f"{corpus[40][1]} {t} {corpus[41][1]}", "k", None, None, 1) for i, t in items]
    w = items[5][1].split()
    planted.append((300, " ".join(x for k, x in enumerate(w) if k % 9), "k", None, None, 1))  # a paraphrase with words left out
    rows = docs.union(spark.createDataFrame(planted, docs.schema))
    got = {(r["doc_id"], r["item_id"]) for r in benchmark_leaks(rows, benchmark).collect()}
    assert got == {(200 + i, i) for i, _ in items} | {(300, 5)}
    left = without_leaks(rows, benchmark)
    assert left.columns == rows.columns and left.count() == docs.count()
    assert benchmark_leaks(rows, benchmark.where("false")).count() == 0
    assert common_subsequence([b"a", b"b", b"c", b"a"], [b"b", b"x", b"a", b"a"]) == 2


def test_leaks_of_an_item_that_many_documents_hold(spark):
    from tidemark.llm.leaks import benchmark_leaks, without_leaks

    rng = random.Random(7)
    common = [f"c{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(common) for _ in range(n))
    own = [f"q{i}" for i in range(40)]
    items = [(0, " ".join(own)), (1, text(24)), (2, text(45))]  # items 1 and 2 have words of most documents alone
    rows = [(i, f"{text(30)} {items[0][1] if i % 2 else text(40)} {text(30)}") for i in range(120)]
    changed = " ".join(w for k, w in enumerate(own) if k % 4)
    rows += [(200, f"{text(50)} {changed} {text(50)}"), (201, f"{text(90)} {items[1][1]} {text(33)}"), (202, f"{text(11)} {items[2][1]} {text(70)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = {(i, 0) for i in range(1, 120, 2)} | {(200, 0), (201, 1), (202, 2)}
    assert {(r["doc_id"], r["item_id"]) for r in benchmark_leaks(docs, benchmark).collect()} == want
    assert {r["doc_id"] for r in without_leaks(docs, benchmark).collect()} == set(range(0, 120, 2))


def test_a_benchmark_of_many_passages_keeps_its_cosines(spark):
    from tidemark.llm import leaks

    rng = random.Random(8)
    items = [(i, " ".join(f"q{rng.randrange(9000)}" for _ in range(28))) for i in range(1500)]
    alone = lambda k: f"d{rng.randrange(10**9)}"
    spread = lambda t: " ".join(x for k, w in enumerate(t.split()) for x in ([w, alone(k)] if k % 2 else [w]))  # noqa: E731  (no three words in a row)
    docs = spark.createDataFrame([(i, t) for i, t in items] + [(5000 + i, spread(t)) for i, t in items[:300]], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = leaks.benchmark_leaks(docs, benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(i, i) for i in range(1500)] + [(5000 + i, i) for i in range(300)]
    assert all(r["cosine"] > 0.99 for r in rows if r["doc_id"] == r["item_id"])


def test_pipeline_keeps_columns_and_runs(spark, tmp_path, docs):
    import corpus_pipeline

    docs.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{i}-{name}")
        now = spark.read.parquet(f"{tmp_path}/{i}-{name}")
        assert i == len(corpus_pipeline.STAGES) - 1 or now.columns == columns
    assert now.count() > 0


@pytest.mark.parametrize("percent", [5, 50, 100])
def test_leaks_against_brute_force_however_many_documents_hold_an_item(spark, percent):
    import numpy as np

    from tidemark.llm import leaks

    rng = random.Random(percent)
    common, rare = [f"c{i}" for i in range(40)], [f"r{i}" for i in range(3000)]
    text = lambda n: [rng.choice(common if rng.random() < 0.5 else rare) for _ in range(n)]
    items = [text(n) for n in (36, 60, 20, 44, 90, 15)]

    def paraphrase(item):
        """The item with words left out and put in: no three of its words in a row stay."""
        kept = [w for k, w in enumerate(item) if k % 7]
        return [x for k, w in enumerate(kept) for x in ([w, f"x{rng.randrange(10**6)}"] if k % 2 else [w])]

    rows = [(i, " ".join(text(30) + (items[0] if i % 100 < percent else text(36)) + text(25))) for i in range(200)]
    rows += [(1000 + 10 * k + j, " ".join(text(40 + j) + paraphrase(item) + text(31))) for k, item in enumerate(items) for j in range(4)]
    rows += [(2000, None), (2001, ""), (2002, " ".join(text(4000) + items[1] + text(3000))), (2003, rows[0][1]), (2003, rows[0][1])]
    want = set()
    for i, t in rows:
        w = (t or "").split()
        for k, item in enumerate(items):
            share = max(leaks.common_subsequence(item, w[max(0, at - len(item)) : at + 28 + len(item)]) / len(item) for at in range(0, max(1, len(w)), 14))
            if share >= 0.75 or share >= 0.5 and f" {' '.join(item[-6:])} " in f" {t} ":
                want.add((i, k))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.benchmark_leaks(docs, spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
    assert {(i, 0) for i in range(200) if i % 100 < percent} | {(2002, 1)} <= got


def test_the_latent_space_is_that_of_a_whole_svd(spark):
    import numpy as np

    from tidemark.llm import leaks

    rng = random.Random(5)
    items = [(i, " ".join(f"q{rng.randrange(60)}" for _ in range(40))) for i in range(30)]
    terms = {w.encode(): i for i, w in enumerate(sorted({w for _, t in items for w in t.split()}), 1)}
    idf = np.r_[0, np.linspace(1, 5, len(terms))].astype(np.float32)
    basis, values = leaks.latent_space(spark.createDataFrame(items, "item_id long, text string"), terms, idf, 60)
    rows = []
    for _, t in items:
        for part in leaks._item_passages(leaks._ids(t.encode().split(), terms)):
            at, w = leaks._unit(part, idf)
            rows.append(np.bincount(at, w, len(idf)))
    want = np.linalg.svd(np.array(rows), compute_uv=False)
    assert np.allclose(values, want[: len(values)], rtol=0.02) and (values**2).sum() >= 0.94 * (want**2).sum() and len(values) < len(want)
    assert np.allclose(basis.T @ basis, np.eye(len(values)), atol=1e-4)


def test_stages_keep_columns_of_any_name(spark, corpus):
    """Rows with null ids, texts and extra columns, named like what the stages use inside, pass through every stage."""
    import corpus_pipeline

    names = "kept_id|my col|a.b|row|key|score|all|gone|spans|cut|hash|draw|_0|n_chars|Ä"
    schema = ", ".join(f"`{n}` {'int' if n == 'n_chars' else 'string'}" for n in names.split("|")[:7]) + ", doc_id long, text string, " + ", ".join(f"`{n}` {'int' if n == 'n_chars' else 'string'}" for n in names.split("|")[7:])
    rows = [(*"abcdefg", i, t, *"hijklm", len(t or ""), None) for i, t in corpus]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, int(i % 7 == 0), "x") for i in range(60)], "doc_id long, toxic int, text string")
    benchmark = spark.createDataFrame([(1, corpus[45][1], "x"), (None, "a b", "x"), (2, None, "x")], "item_id long, text string, doc_id string")
    from tidemark.llm.jaccard import one_of_each
    from tidemark.llm.leaks import without_leaks
    from tidemark.llm.substrings import without_repeats
    from tidemark.llm.toxicity import without_toxic

    for stage in (lambda d: without_toxic(d, labels), one_of_each, without_repeats, lambda d: without_leaks(d, benchmark)):
        out = stage(docs)
        assert out.dtypes == docs.dtypes and 0 < out.count() <= len(rows)
        assert {tuple(r)[:7] for r in out.collect()} == {tuple("abcdefg")}
        assert any(r["doc_id"] is None for r in out.collect()) or stage is not one_of_each
        assert stage(docs.where("false")).count() == 0
    assert corpus_pipeline.tokens(spark, docs, "").count() == len(rows)


def test_pipeline_stages_against_plain_versions(spark, tmp_path, docs, corpus):
    """Each stage on what its predecessor kept; labels are learned, so the first one is held to planted words alone."""
    tokenizers = pytest.importorskip("tokenizers")
    import corpus_pipeline
    from tidemark.llm.queries import vocabulary

    rng = random.Random(13)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    bad = [(1000 + i, " ".join(w if k % 9 else "grumbzot" for k, w in enumerate(text(60).split()))) for i in range(120)]
    fine = [(2000 + i, text(60)) for i in range(240)]
    item = " ".join(f"q{i}" for i in range(40))
    leaked = [(3000, f"{text(30)} {item} {text(30)}")]
    rows = [(i, t, "x", "en", "s", 7) for i, t in bad + fine + leaked]
    whole = docs.union(spark.createDataFrame(rows, docs.schema)).withColumn("n_chars", F.length("text").cast("long"))
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 1) for i, _ in bad] + [(i, 1, 0) for i, _ in fine], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, now = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append(now.collect())
    clean, single, cut, safe, tokens = kept
    ids = {r["doc_id"] for r in clean}
    assert not ids & {i for i, _ in bad} and ids >= {i for i, _ in fine + leaked}

    label = {r["doc_id"]: r["doc_id"] for r in clean if r["doc_id"] is not None}
    top = lambda i: i if label[i] == i else top(label[i])
    sets = sorted({(r["doc_id"], r["text"]) for r in clean if r["doc_id"] is not None}, key=str)
    sets = [(i, shingle_set(t)) for i, t in sets]
    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                label[y] = x
    assert {r["doc_id"] for r in single} == {top(i) for i in label} | {None}

    first = {}
    for r in single:
        w = words(r["text"])
        for k in range(len(w) - 49) if r["doc_id"] is not None else ():
            first[tuple(w[k : k + 50])] = min(r["doc_id"], first.get(tuple(w[k : k + 50]), r["doc_id"]))

    def left(i, t):
        w = words(t)
        gone = {k + d for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for d in range(50)}
        return " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t

    assert sorted(((r["doc_id"], r["text"]) for r in cut), key=str) == sorted(((r["doc_id"], left(r["doc_id"], r["text"])) for r in single), key=str)
    assert {r["doc_id"] for r in safe} == {r["doc_id"] for r in cut} - {3000}
    library = tokenizers.Tokenizer.from_file(vocabulary())
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in tokens), key=str) == sorted(((r["doc_id"], len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in safe), key=str)


def test_leaks_of_a_very_long_item_are_compared_a_few_times(monkeypatch):
    from tidemark.llm import leaks

    words = [(f"word{i % 977}" if i % 2 else f"x{i % 13}").encode() for i in range(6000)]
    terms = {w: i for i, w in enumerate(sorted(set(words)), 1)}
    matcher = leaks.Matcher([(1, leaks._ids(words, terms))], np.r_[0, np.ones(len(terms))].astype(np.float32), np.eye(len(terms) + 1, dtype=np.float32))
    calls, plain = [], leaks.common_subsequence
    monkeypatch.setattr(leaks, "common_subsequence", lambda a, b: calls.append(len(b)) or plain(a, b))
    changed = [b"x1" if i % 50 == 0 else w for i, w in enumerate(words)]
    (found,) = leaks.leaks([b" ".join(changed)], terms, [matcher])
    assert found[:2] == (0, 1) and found[3] == plain(leaks._ids(words, terms).tolist(), leaks._ids(changed, terms).tolist()) / 6000 < 1
    assert len(calls) < 20


def test_leaks_give_the_best_of_all_places():
    """Each item's best share over all of its places in a text, compared one by one."""
    from tidemark.llm import leaks

    r = random.Random(5)
    for _ in range(10):
        vocabulary = [f"w{i}".encode() for i in range(r.choice([20, 200]))]
        items = [[r.choice(vocabulary) for _ in range(r.choice([3, 12, 40, 120, 300]))] for _ in range(6)]
        terms = {w: i for i, w in enumerate(sorted({w for x in items for w in x}), 1)}
        matcher = leaks.Matcher([(i, leaks._ids(x, terms)) for i, x in enumerate(items)], np.r_[0, np.ones(len(terms))].astype(np.float32), np.eye(len(terms) + 1, dtype=np.float32))
        text = []
        for _ in range(12):
            text += [r.choice(vocabulary) if r.random() < r.choice([0, 0.1, 0.4]) else w for w in r.choice(items)] + [b"zz"] * r.choice([0, 5, 80])
        ids = leaks._ids(text, terms)
        halves = len(ids) // leaks.HALF + 2
        flat = np.zeros(halves * leaks.HALF, np.int32)
        flat[: len(ids)] = ids
        places = {*matcher._near(flat.reshape(-1, leaks.HALF)), *matcher.runs.found(flat)}
        want: dict = {}
        for p, k in places:
            if told := matcher._verified(ids, k, p):
                want[k] = max(want.get(k, 0), told[0])
        assert {x[1]: x[3] for x in leaks.leaks([b" ".join(text)], terms, [matcher])} == want and want
