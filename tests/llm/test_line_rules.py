"""Line-first rules against plain Python."""

import random
import re
from collections import Counter

import pytest

from regioscope.llm import line_rules

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(text):
    w = words(text)
    runs = Counter(zip(w, w[1:], w[2:]))
    hit = {i + j for i in range(len(w) - 2) if runs[tuple(w[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))


@pytest.fixture(scope="module")
def rows(texts):
    rng = random.Random(8)
    out = list(texts)
    for i in range(60):  # few different words: many repeated runs
        out.append((200 + i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 70)))))
    out += [(300, "x y z " * 30_000), (301, "a|b #1\x0b$5\x0c<i>\r\n\n a|b\n a|b\na|b "), (302, "日本語 テキスト。\n日本語 テキスト。"),
            (303, " ".join(map(str, range(200_000)))), (303, "again"), (None, "one two three one two three")]
    return out


def test_base(spark, rows):
    df = spark.createDataFrame([(*r, "a", 1, "x") for r in rows],
                               "doc_id long, text string, line string, w int, kept string").repartition(3)
    got = sorted(tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in line_rules.judge(df).collect() if r["doc_id"] is not None)
    assert got == sorted((i, *brute(t)) for i, t in rows if i is not None)
    none = [r for r in line_rules.judge(df).collect() if r["doc_id"] is None]
    assert [r["n_repeat_words"] for r in none] == [6]
    assert line_rules.judge(df.limit(0)).collect() == []


LINES = [("A sentence of prose ends here.", False), ("„Eine Frage?“", False), ('He said "no."', False), ("これは文です。", False),
         ("No mark at the end", True), ("Home | About | Contact.", True), ("One › two › three › four.", True),
         ("All rights reserved.", True), ("Please read our Privacy Policy.", True), ("words### with%%% symbols$$$ all.", True),
         ("The pipe | stands once in a line of many words.", False), ("", False), ("   ", False),
         ("They talked about a cookie and " + "many other things " * 8 + "that evening.", False)]


def test_lines(spark):
    df = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(LINES)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_failed_lines"], r["clean_text"]) for r in line_rules.judge(df).collect()}
    for i, (line, fails) in enumerate(LINES):
        assert got[i] == (int(fails), "" if fails else line), line


def test_documents_that_lose_too_much(spark):
    rng = random.Random(2)
    prose = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) + "." for _ in range(6)]
    bare = [x[:-1] for x in prose]
    texts = {1: prose, 2: prose[:4] + bare[4:], 3: prose[:2] + bare[2:], 4: bare, 5: prose[:2],
             6: prose + ["Home | News | About | Login", "Copyright 2020."]}
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_rules.judge(df).collect()}
    assert {i for i, r in got.items() if r["kept"]} == {1, 2, 6}
    assert got[5]["base_failed"] and not got[4]["base_failed"] and got[4]["lost_chars"] == got[4]["word_chars"]
    assert got[6]["clean_text"] == "\n".join(prose) and got[6]["n_failed_lines"] == 2
