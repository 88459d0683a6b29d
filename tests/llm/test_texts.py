"""Operators on documents against brute force, with hostile rows."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from regioscope.llm import (bpe_boundaries, context_tree, line_dedup, odd_sketch, suffix_radix, winnowing)
from regioscope.llm.queries import vocabulary


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.fixture(scope="module")
def empty(documents):
    return documents.limit(0)


def test_bpe_equals_the_library(documents, texts, empty):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(vocabulary())
    rows = by_id(bpe_boundaries.digests(documents, vocabulary()), "n_tokens", "ids_sha256", "decoded_sha256")
    for i, t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert rows[i] == (len(ids), brute.sha(",".join(map(str, ids))),
                           brute.sha(lib.decode(ids, skip_special_tokens=False)))
    assert bpe_boundaries.digests(empty, vocabulary()).collect() == []


def test_bpe_on_odd_strings():
    import random

    from tokenizers import Tokenizer
    lib, own = Tokenizer.from_file(vocabulary()), bpe_boundaries.load(vocabulary())
    rng = random.Random(1)
    pool = ["'s", "'re", "''", " ", "  ", "\n", "\t", "a", "é", "1", "٣", "!", "¡", "、", "　",
            " ", "\xa0", "\x85", "\x1c", "<|endoftext|>", "<|endof", "the", " don't", "日", "\U0001F600",
            "́", "\x00", "\r\n", "%%%", "'LL", "​"]
    for _ in range(3000):
        s = "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        ids = lib.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(s.encode()), "<i4").tolist() == ids
        assert own.decode(np.array(ids, int)) == lib.decode(ids, skip_special_tokens=False)


def test_certain_cuts_lie_in_no_token():
    own = bpe_boundaries.load(vocabulary())
    cut = own.cut.reshape(256, 256)
    assert cut[ord("e"), ord(" ")] and not cut[ord("t"), ord("h")]
    assert not any(cut[x, y] for t in own.bytes_of if t != b"<|endoftext|>" for x, y in zip(t, t[1:]))
    assert own.fragments(b"the end") == [b"the", b" end"]


def test_near_documents(documents, texts, empty):
    rows = by_id(odd_sketch.near_duplicates(documents), "n_shingles", "component_id", "kept")
    assert rows == brute.near_documents(dict(texts))
    assert odd_sketch.near_duplicates(empty).collect() == []


def test_near_documents_repeated_and_missing_ids(spark):
    long = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(3, long), (3, long), (None, long), (5, long + " x"), (None, "alone here")],
                               "doc_id long, text string")
    rows = sorted(map(tuple, odd_sketch.near_duplicates(df).collect()), key=str)
    assert rows == sorted([(3, 26, 3, True), (3, 26, 3, True), (None, 26, 3, False), (5, 27, 3, False),
                           (None, 1, None, True)], key=str)


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    for shared in (1000, 950, 900, 860):
        y = np.concatenate([x[:shared], rng.integers(0, 1 << 63, 1000 - shared, dtype=np.uint64)])
        j = shared / (2000 - shared)
        a, b = odd_sketch.odd_sketches(odd_sketch.min_samples([x, y]))
        differing = int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
        assert abs(differing - odd_sketch.most_differing_bits(j)) < 120
        if j >= 0.75:
            assert differing <= odd_sketch.most_differing_bits(0.75 - odd_sketch.SLACK)


def test_repeated_bytes(documents, texts, empty):
    for length in (200, 64):
        want = brute.without_repeats(texts, length)
        rows = by_id(suffix_radix.remove_repeats(documents, length), "n_bytes", "spans", "kept")
        assert {i: (n, [tuple(s) for s in spans], bytes(kept)) for i, (n, spans, kept) in rows.items()} == want
    assert suffix_radix.digests(empty).collect() == []


def test_repeated_rows_are_repeats_of_each_other(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(300))
    df = spark.createDataFrame([(1, text), (1, text), (None, "é" * 99), (None, None)], "doc_id long, text string")
    rows = [tuple(r)[:4] for r in suffix_radix.digests(df).collect()]
    assert sorted(rows, key=str) == sorted([(1, 300, 300, 1), (1, 300, 300, 1), (None, 198, 0, 0), (None, 0, 0, 0)],
                                           key=str)


def test_long_texts_are_scanned_in_parts(spark, monkeypatch):
    """A row longer than a slice: the same result as in one piece."""
    import random
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(700_000))
    text += " " + text[1000:1900]
    df = spark.createDataFrame([(1, text), (2, text[500_000:500_400])], "doc_id long, text string")
    rows = by_id(suffix_radix.remove_repeats(df), "spans")
    assert [tuple(s) for s in rows[1][0]] == [(1000, 1900), (500_000, 500_400), (700_001, 700_901)]
    assert [tuple(s) for s in rows[2][0]] == [(0, 400)]


@pytest.fixture(scope="module")
def items(spark, texts):
    words = dict(texts)[92].split(" ")
    rows = [(1, " ".join(words[100:130])), (2, " ".join(words[105:118])), (3, "two words"), (4, None), (5, " ,. "),
            (6, dict(texts)[71]), (6, dict(texts)[71]), (10, "TWO, words"), (7, " ".join(words[200:209]))]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


def test_winnowing(documents, texts, items, empty):
    want = brute.benchmark_hits(texts, items[0])
    rows = by_id(winnowing.contamination(documents, items[1]), "n_words", "n_hit", "items")
    assert rows == {i: (n, h, f) for i, (n, h, f) in want.items()}
    kept = {r["doc_id"] for r in winnowing.decontaminate(documents, items[1]).collect()}
    assert kept == {i for i, (n, h, _) in want.items() if not (h and 20 * h >= n)}
    assert winnowing.decontaminate(documents, items[1]).columns == documents.columns
    assert winnowing.digests(empty, items[1]).collect() == []
    none = winnowing.digests(documents, items[1].limit(0))
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(texts)


def test_winnowing_joins_by_shuffle_too(documents, items, monkeypatch):
    want = {tuple(map(str, r)) for r in winnowing.contamination(documents, items[1]).collect()}
    monkeypatch.setattr(winnowing, "SMALL_ROWS", 0)
    assert {tuple(map(str, r)) for r in winnowing.contamination(documents, items[1]).collect()} == want


def test_lines(documents, texts, empty):
    out = line_dedup.dedup_lines(documents)
    assert out.columns == [*documents.columns, "n_lines", "n_removed"]
    assert {r["doc_id"]: r["text"] for r in out.collect()} == brute.deduped_lines(dict(texts))
    assert line_dedup.dedup_lines(empty).collect() == []


def test_lines_of_many_words(spark):
    """Lines of more words than a chunk counts, and many documents with one
    line in common."""
    import random
    rng = random.Random(3)
    long = [f"w{rng.randrange(10**6)}" for _ in range(700)]
    other = list(long)
    other[350] = "changed"
    rows = [(1, " ".join(long)), (2, "start\n" + " ".join(other)), (3, None)]
    rows += [(10 + i, "the very same line in all of these\n" + f"own {i} line number {i} of five words {i * 7}")
             for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == brute.deduped_lines(dict(rows))
    assert got[2] == "start" and sum("the very same" in (t or "") for t in got.values()) == 1


def test_simhash(spark):
    import random
    rng = random.Random(4)
    rows = [(i, [f"t{rng.randrange(500)}" for _ in range(n)]) for i, n in enumerate((1, 2, 3, 8, 126, 127, 128, 400, 1200))]
    df = spark.createDataFrame(rows, "k long, w array<string>").select(
        "k", F.array_distinct(F.transform("w", lambda x: F.xxhash64(x))).alias("h"))
    got = {r["k"]: r["sim"] & (2**64 - 1) for r in line_dedup.with_simhash(df, ["k"], "h").collect()}
    assert got == {i: brute.simhash(w) for i, w in rows}


def test_common_ends_leave_the_edit_distance(spark):
    import random
    rng = random.Random(6)
    rows = []
    for _ in range(300):
        x = [rng.choice("a bb ccc dd".split()) for _ in range(rng.randint(1, 9))]
        y = list(x)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(y) + 1)
            y[at:at + rng.randint(0, 1)] = ["zz"] * rng.randint(0, 2)
        rows.append((x, y or ["a"]))
    df = spark.createDataFrame(rows, "x array<string>, y array<string>").withColumns({"p": F.col("x"), "q": F.col("y")})
    got = line_dedup.without_common_ends(df, "p", "q").withColumn("d", F.levenshtein("p", "q")).collect()
    assert all(r["d"] == brute.edit_distance(" ".join(r["x"]), " ".join(r["y"])) for r in got)
    bounds = [(r["at_most"], r["d"]) for r in got if r["at_most"] is not None]
    assert len(bounds) > 50 and all(b >= d for b, d in bounds)


def test_context_tree(documents, texts, empty, monkeypatch):
    small = [(i, t) for i, t in texts if i != 92]
    df = documents.where("doc_id != 92")
    word, tree = brute.word_scores(dict(small)), brute.tree_scores(dict(small), context_tree.DEPTH)
    for size in (1 << 30, 4000):  # one block, many blocks
        monkeypatch.setattr(context_tree, "BLOCK_BYTES", size)
        rows = by_id(context_tree.score(df), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        for i, _ in small:
            assert rows[i][:4] == word[i][:4]
            assert rows[i][4] == pytest.approx(word[i][4], rel=1e-9)
            assert rows[i][5] == pytest.approx(tree[i], rel=1e-9)
    assert context_tree.score(empty).collect() == []


def test_grams_of_long_rows_come_in_parts(monkeypatch):
    text = np.frombuffer(b"Hello, world. And so on.", np.uint8)
    off = np.array([0, 5, 5, len(text)])
    whole = [np.concatenate(x) for x in zip(*context_tree.grams(text, off))]
    monkeypatch.setattr(context_tree, "STEP", 4)
    parts = [np.concatenate(x) for x in zip(*context_tree.grams(text, off))]
    assert all((a == b).all() for a, b in zip(whole, parts))
    assert len(whole[0]) == len(text) + 3 and whole[1][0] == 0xFEFEFEFE << 8 | ord("h")


def test_probabilities_add_up():
    """The bytes that may follow one context, seen or not, sum to one."""
    rng = np.random.default_rng(0)
    context = np.uint64(0x74686520) << np.uint64(8)
    keys = np.concatenate([context + np.arange(256, dtype=np.uint64),
                           (np.uint64(0x74686521) << np.uint64(8)) + np.arange(50, dtype=np.uint64)])
    counts = np.where(rng.random(len(keys)) < 0.2, rng.integers(1, 50, len(keys)), 0)
    tree = context_tree._Tree(keys, counts)
    n0, n1 = rng.integers(0, 99, (2, 256, 256))
    top = context_tree.upper(n0, n1, -rng.random((256, 256)))
    p = np.exp(tree.probabilities(*top, np.full(len(keys), 0x74)))
    assert p[:256].sum() == pytest.approx(1)


def near_lines(rng, count):
    """(line, near copy): one of n words replaced, letters changed, in lines
    of one to sixty words, and text without spaces."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    for n in range(count):
        kind = ("word", "letters", "solid", "one")[n % 4]
        words = [word() for _ in range(rng.randint(12, 60) if kind == "word" else rng.randint(2, 40))]
        line = " ".join(words)
        if kind == "solid":
            line = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(rng.randint(10, 80)))
        if kind == "word":
            most = int(len(line) * 0.1)
            short = [i for i, w in enumerate(words) if len(w) <= most]
            i = rng.choice(short)
            words[i] = word()[:len(words[i])]
            yield kind, line, " ".join(words)
            continue
        edits = 1 if kind == "one" else max(1, int(len(line) * 0.05))
        if int(len(line) * 0.1) < edits:
            continue
        chars = list(line)
        for i in rng.sample([i for i, c in enumerate(chars) if c != " "], edits):
            chars[i] = "q"
        yield kind, line, "".join(chars)


def test_all_lines_by_edit_similarity(spark):
    import math
    import random
    from collections import Counter
    pairs = list(near_lines(random.Random(8), 1200))
    near = [math.floor(max(len(x), len(y)) * 0.1 + 1e-9) >= brute.edit_distance(x, y) for _, x, y in pairs]
    assert sum(near) > 1000
    rows = [(i, x) for i, (_, x, _) in enumerate(pairs)] + [(10_000 + i, y) for i, (_, _, y) in enumerate(pairs)]
    got = by_id(line_dedup.dedup_all_lines(spark.createDataFrame(rows, "doc_id long, text string")), "text")
    of = Counter(k for (k, _, _), n in zip(pairs, near) if n)
    gone = Counter(k for i, ((k, _, _), n) in enumerate(zip(pairs, near)) if n and got[10_000 + i] == ("",))
    assert all(gone[k] >= 0.95 * n for k, n in of.items()), (gone, of)
    assert all(got[10_000 + i] == (y,) for i, ((_, _, y), n) in enumerate(zip(pairs, near)) if not n)


def test_short_and_solid_lines_go(spark):
    rows = [(i, f"les.\nHome\n東京都千代田区一丁目二番三号四五六七\n\nown {i * 7919}") for i in range(100)]
    got = by_id(line_dedup.dedup_all_lines(spark.createDataFrame(rows, "doc_id long, text string")), "text")
    assert got[0] == (rows[0][1],) and all(got[i][0].split("\n")[0] == "" for i in range(1, 100))


def test_short_lines_lose_no_pair(spark):
    """As many edits as are allowed, all over the line, spaces too."""
    import math
    import random
    rng = random.Random(11)
    pairs = []
    while len(pairs) < 200:
        size = rng.randint(10, line_dedup.SHORT)
        x = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(size)).split())
        y = list(x)
        for _ in range(int(len(x) * 0.1)):
            at = rng.randrange(len(y))
            y[at:at + rng.randint(0, 1)] = rng.choice(["", "q", " ", "z"])
        pairs.append((x, " ".join("".join(y).split())))
    near = [x != y and math.floor(max(len(x), len(y)) * 0.1 + 1e-9) >= brute.edit_distance(x, y) for x, y in pairs]
    assert sum(near) > 100
    rows = [(i, x) for i, (x, _) in enumerate(pairs)] + [(10_000 + i, y) for i, (_, y) in enumerate(pairs)]
    got = by_id(line_dedup.dedup_all_lines(spark.createDataFrame(rows, "doc_id long, text string")), "text")
    assert all(got[10_000 + i] == ("",) for i, n in enumerate(near) if n)


def test_frequent_runs_lose_no_pair(spark, monkeypatch):
    """Lines that quote one passage, some of them near copies that differ
    outside of it, with nearly every run frequent."""
    import random
    monkeypatch.setattr(line_dedup, "HOT", 1)
    monkeypatch.setattr(line_dedup, "LED", 4)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    passage, lines = " ".join(word() for _ in range(12)), []
    for _ in range(14):
        tail = [word() for _ in range(8)]
        lines.append(passage + " " + " ".join(tail))
        for at in rng.sample(range(8), 2):
            lines.append(passage + " " + " ".join([*tail[:at], "q" * len(tail[at]), *tail[at + 1:]]))
    links = [(i, j) for i, x in enumerate(lines) for j in range(i)
             if brute.edit_distance(x, y := lines[j]) <= max(len(x), len(y)) // 10]
    assert len(links) >= 28 and min(map(len, lines)) > line_dedup.SHORT
    of = brute.components(range(len(lines)), links)
    rows = list(enumerate(lines))
    got = by_id(line_dedup.dedup_all_lines(spark.createDataFrame(rows, "doc_id long, text string")), "text")
    first = {c: min(i for i in of if of[i] == c) for c in of.values()}
    assert {i for i, (t,) in got.items() if t} == set(first.values())


def test_lines_that_share_only_frequent_runs(spark, monkeypatch):
    """Near copies that share a quoted passage alone: its runs count as much
    as rare ones, however many lines have them."""
    import random
    monkeypatch.setattr(line_dedup, "HOT", 1)
    monkeypatch.setattr(line_dedup, "LED", 10**6)
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 7)))
    passage, lines = " ".join(word() for _ in range(12)), []
    for _ in range(25):
        tail = [word() for _ in range(8)]
        lines.append(" ".join([passage, *tail]))
        lines.append(" ".join([passage, *("q" + w[1:] if i % 2 == 0 else w for i, w in enumerate(tail))]))
    links = [(i, j) for i, x in enumerate(lines) for j in range(i)
             if brute.edit_distance(x, y := lines[j]) <= max(len(x), len(y)) // 10]
    assert len(links) >= 25 and min(map(len, lines)) > line_dedup.SHORT
    of = brute.components(range(len(lines)), links)
    got = by_id(line_dedup.dedup_all_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")), "text")
    first = {c: min(i for i in of if of[i] == c) for c in of.values()}
    assert {i for i, (t,) in got.items() if t} == set(first.values())


def test_a_tenth_of_the_letters_spread_over_long_lines(spark, monkeypatch):
    """As many edits as are allowed, all over the line, spaces too, and every
    run taken as frequent."""
    import random
    monkeypatch.setattr(line_dedup, "HOT", 0)
    rng = random.Random(16)
    letters, pairs = "abcdefghijklmnopqrstuvwxyz", []
    for n in range(600):
        x = ""
        while len(x) <= (100, 150, 250)[n % 3]:
            x += "".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) + " "
        x = x.strip() + "x"
        y = list(x)
        for at in sorted(rng.sample(range(len(y)), len(x) // 10), reverse=True):
            y[at:at + rng.randint(0, 1)] = rng.choice(["", " ", *letters])
        pairs.append((n % 3, x, " ".join("".join(y).split())))
    near = [max(len(x), len(y)) // 10 >= brute.edit_distance(x, y) > 0 for _, x, y in pairs]
    rows = [(i, x) for i, (_, x, _) in enumerate(pairs)] + [(10_000 + i, y) for i, (_, _, y) in enumerate(pairs)]
    got = by_id(line_dedup.dedup_all_lines(spark.createDataFrame(rows, "doc_id long, text string")), "text")
    for size in range(3):
        gone = [got[10_000 + i] == ("",) for i, (k, _, _) in enumerate(pairs) if k == size and near[i]]
        assert len(gone) > 100 and sum(gone) >= 0.9 * len(gone), (size, sum(gone), len(gone))


def test_pieces_tell_no_near_texts_apart(spark):
    """Texts within the allowed edits pass; unlike ones of one length go."""
    import random
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmnop😀é") for _ in range(rng.randint(2, 8)))
    rows = []
    for _ in range(150):
        x = " ".join(word() for _ in range(rng.randint(3, 40)))
        y = list(x)
        for _ in range(len(x) // 10):
            at = rng.randrange(len(y))
            y[at:at + rng.randint(0, 1)] = rng.choice(["", "q", " ", "zz"[:1]])
        rows.append((x, "".join(y), True))
        rows.append((x, " ".join(word() for _ in range(50))[:len(x)], False))
    most = F.floor(F.greatest(F.char_length("x"), F.char_length("y")) * 0.1 + 1e-9).cast("int")
    df = spark.createDataFrame(rows, "x string, y string, near boolean")
    got = df.withColumn("found", line_dedup._pieces_found(F.col("x"), F.col("y"), most)).collect()
    assert all(r["found"] for r in got if r["near"])
    assert not any(r["found"] for r in got if not r["near"])


def test_pairs_are_met_in_every_range_of_lengths(spark, monkeypatch):
    """Near lines of all lengths, also on both sides of a range's end, with
    frequent runs of words in all: the links that brute force finds."""
    import random
    monkeypatch.setattr(line_dedup, "HOT", 2)
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))
    lines = []
    for n in range(40):
        words = ["alpha", "beta", "gamma", *(word() for _ in range(4 + 2 * n))]
        lines.append(" ".join(words))
        lines.append(" ".join([*words, "q" * (len(lines[-1]) // 12)]))  # longer by less than a tenth
    links = [(i, j) for i, x in enumerate(lines) for j in range(i)
             if brute.edit_distance(x, y := lines[j]) <= max(len(x), len(y)) // 10]
    assert len(links) >= 38
    of = brute.components(range(len(lines)), links)
    assert len(line_dedup._bands(line_dedup.feature_sets(spark.createDataFrame(
        [(i, x, len(x)) for i, x in enumerate(lines)], "key long, line string, len int"), 0.9))) == line_dedup.BANDS
    got = by_id(line_dedup.dedup_all_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")), "text")
    first = {c: min(i for i in of if of[i] == c) for c in of.values()}
    assert {i for i, (t,) in got.items() if t} == set(first.values())
