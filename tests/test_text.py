"""First hits of ordered pattern lists against the plain loop."""

import random
import re
import time

import pytest

from mediasift.operators import text
from mediasift.operators.text import FOLD, FirstHit, portable, required, text_check, usable_patterns

PATTERNS = ["license", r"token\s*=", "worthless|stupid", r"(?P<w>ab)c", r"(?:x|yy)+z{2,3}", "[a-f]{3}1", "a.b", r"\bfoo\b", r"(a)\1b", "(?s)q.r", "(?<=k)ey", "b(?i:AD)", r"\d{3}", "end$", "^start", "ß", "é+t", r"s\w+k", "[^a-z]ok", "x*?lazy", "(?>atom)ic", "wo++w", "(", "a+", "straße", "sıx"]
ALPHABET = ["a", "b", "c", "k", "K", "S", "ſ", "ı", "İ", "K", " ", "\n", "1", "23", "ok", "token =", "abc", "aab", "foo", "ß", "É", "t", "x", "yyzz", "lazy", "atomic", "woww", "start", "end", "key", " ", "\x85", "(", "q\nr", "straße", "six", "license", "bad"]


def plain(patterns, whole, least=3):
    whole = whole.strip()
    return next((p for p in patterns if re.compile(p, re.IGNORECASE).search(whole)), None) if len(whole) >= least else None


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return ["", " ", "\n\nab\n", "\x1f　abc "] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 9))) for _ in range(1500)]


def test_automaton_and_jvm_agree_with_the_plain_loop(spark, texts):
    patterns = usable_patterns(PATTERNS)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "id long, text string").repartition(3)
    rng = random.Random(2)
    lists = [patterns, patterns[::-1], [p for p in patterns if portable(p)], [], ["a.b"], [r"(?P<w>ab)c"], *(rng.sample(patterns, 4) for _ in range(4))]
    assert [text.in_jvm(x) for x in lists[:6]] == [False, False, True, True, True, True]
    for some in lists:
        got = text_check(df, "id", "text", some, 3, shown=4)
        want = {i: (plain(some, t), t.strip()[:4] if len(t.strip()) >= 3 else "") for i, t in enumerate(texts)} | {-1: (None, "")}
        assert {r["id"]: (r["hit"], r["text"]) for r in got.collect()} == want
        assert all((r["ocr_match"] == 1.0) == (r["hit"] is not None) for r in got.collect())


def test_required_literals_occur_in_every_match(texts):
    patterns = usable_patterns(PATTERNS)
    for p in patterns:
        held = required(p)
        for t in texts:
            found = re.search(p, t, re.IGNORECASE)
            if held and found:
                assert any(x in t.translate(FOLD) for x in held)
    assert required("worthless|stupid") == ("worthless", "stupid") and required(r"\d{3}") == () and required("(?:ab|cd)?e") == ("e",)


def test_letters_alike_are_folded_alike():
    for c in map(chr, range(128)):
        same = re.compile(re.escape(c), re.IGNORECASE)
        for other in map(chr, [*range(0xD800), *range(0xE000, 0x11000)]):
            if same.fullmatch(other):
                assert c.translate(FOLD) == other.translate(FOLD)


def test_time_hardly_grows_with_the_list():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(8))
    bodies = [" ".join(word() for _ in range(300)) for _ in range(200)]
    took = []
    for n in (100, 10_000):
        search = FirstHit(tuple(rf"{word()}\s+{word()}" for _ in range(n)))
        began = time.process_time()
        assert [search(t) for t in bodies] == [None] * len(bodies)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_usable_patterns():
    lines = ["# c", "", "  re:x ", "﻿bom", "b(", "(?P<n>a)", "[a"]
    assert usable_patterns(lines) == ["re:x", "bom", r"b\(", "(?P<n>a)", r"\[a"]
    assert usable_patterns(lines, strip_prefix=True)[0] == "x"
