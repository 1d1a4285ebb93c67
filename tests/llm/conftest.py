import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, size string, row string, _digest string, _own int, comp int, bands string, k string, n int, shard string"


def frame(spark, rows):
    """A documents table from (doc_id, text, source), with other columns whose names operators use inside."""
    return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t), "x", 1, "y", "z", "w", 2, 3, "b", "k", 4, "s") for d, t, s in rows], SCHEMA)


WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "si", "to") for b in ("", "ba", "de", "fi", "go", "hu", "jo", "la", "ve")]


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS))
        if rng.random() < 0.07:
            out[-1] += "."
        if rng.random() < 0.04:
            out[-1] += "\n"
    return " ".join(out).replace("\n ", "\n")


def edited(rng: random.Random, text: str, n: int) -> str:
    words = text.split(" ")
    for i in rng.sample(range(len(words)), min(n, len(words))):
        words[i] = rng.choice(WORDS) + "x"
    return " ".join(words)


#: Rows that every operator must stand: nulls, empty and blank texts, ties, repeats, one very long line, odd characters.
ODD = [
    (None, None, None), (None, "", "a"), (1, "", "a"), (1, "", "a"), (2, " \t\n ", "b"), (3, "one", None), (3, "one", None), (3, "two words", "b"),
    (9007199254740993, "big id beside a null id", "a"), (4, "ONE", "c"), (5, "\n\n\n", "a"), (6, "Ärger über Öl " * 30, "ü"), (7, "a" * 5000, "a"), (8, "#*$ %&| <>" * 40, "b"),
    (10, "𝒳 emoji 😀 <|endoftext|> tail", "c"), (11, "x y  double  spaces   and \r\n ends", "c"), (12, "same line here\n" * 200, "a"),
]


@pytest.fixture(scope="session")
def corpus(spark):
    """A few hundred documents with exact and near copies, shared and repeated lines, and the odd rows."""
    rng = random.Random(7)
    rows = [(100 + i, prose(rng, rng.choice([5, 30, 80, 200, 400])), f"s{i % 5}" if i % 3 else "hot") for i in range(160)]
    base = [r for r in rows if len(r[1].split()) >= 80]
    for j, (_, t, s) in enumerate(base[:30]):
        rows.append((1000 + j, t, s))
        rows.append((2000 + j, edited(rng, t, 1 + j % 6), s))
    group = base[31][1]
    rows += [(3000 + j, edited(rng, group, 2), "hot") for j in range(60)]
    line = prose(rng, 30).replace("\n", " ")
    rows += [(4000 + j, f"{prose(rng, 60)}\n{edited(rng, line, j % 3)}", "s1") for j in range(25)]
    return frame(spark, rows + ODD).cache()


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


class Sets:
    """Union-find, for brute force."""

    def __init__(self):
        self.up = {}

    def find(self, i):
        self.up.setdefault(i, i)
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)

    def groups(self, of):
        out = {}
        for i in of:
            out.setdefault(self.find(i), set()).add(i)
        return {frozenset(g) for g in out.values()}
