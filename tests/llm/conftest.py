import random

import pytest

#: Extra columns whose names the operators use inside.
CLASHES = ["n", "_n", "rep", "key", "shard", "slot", "block", "offset", "score", "rejected", "u", "v", "fp", "_row", "_at", "_h", "_id", "group_size", "component"]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeiou") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source): nulls, empty and long texts, ties, repeated rows, near copies."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(1, 60)) for _ in range(40)]
    rows = [(i, t, "xx" if i % 2 else "yy", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100, None, "xx", "s0"), (101, "", None, None), (102, " \t\n", "yy", "s1"), (103, "123 456 !!", "xx", "s1"), (104, "a\x00b  c .,;\n\n d <|endoftext|> é ", "yy", None)]
    rows += [(110, words(rng, 9000), "xx", "s0"), (111, base[3].replace(" ", "\n"), "yy", "s2"), (112, base[3] + "  ", "yy", "s2"), (113, base[5] + " x", "xx", "s2")]
    rows += [(7, base[7], "xx", "s1"), (7, base[7], "xx", "s1"), (120, base[7], None, "s0"), (121, "x" * 3000, "xx", "s0"), (122, "Ünï " * 50, "yy", "s1"), (None, base[9], "yy", "s1"), (None, "alone here", "xx", "s1")]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    rows = [(*r, None if r[1] is None else len(r[1]), *range(len(CLASHES))) for r in odd_rows]
    extra = ", ".join(f"`{c}` int" for c in CLASHES)
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def components(n, pairs):
    """The smallest member reachable from each of n positions."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
