"""Small tables with every odd row, and plain definitions."""

from __future__ import annotations

import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else (text or ""))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'.' if rng.random() < 0.1 else ''}" for _ in range(n))


def changed(rng, text, share):
    return " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="session")
def odd_texts():
    rng = random.Random(4)
    base, other = prose(rng, 120), prose(rng, 90)
    rows = [(1, base), (2, base), (2, base), (3, base.upper()), (4, changed(rng, base, 0.02)), (5, changed(rng, base, 0.3)), (6, other), (7, other + " " + prose(rng, 30))]
    rows += [(8, None), (9, ""), (10, " \t\n\x0b\x0c\r "), (11, "one"), (12, "one two"), (13, "one two three"), (14, "One  two\tthree"), (15, "one"), (None, base), (None, None), (None, "alone here")]
    rows += [(16, "é ü 漢字  x   " * 30), (17, "long " * 5000 + prose(rng, 4000, 9000)), (18, "z" * 300_000 + " " + "y" * 70_000), (-5, prose(rng, 50)), (2**40, prose(rng, 60))]
    passage = prose(rng, 60, 5000)
    rows += [(100 + i, f"{prose(rng, 40)} {passage} {prose(rng, 20 + i)}") for i in range(12)]
    return rows


#: Extra columns with names that the operators use themselves.
CLASHING = ("_id", "_node", "_of", "_held", "_order", "block", "chunk", "component_id", "held", "key", "kept", "n_chars", "node", "nr", "part", "position", "row", "score", "slot", "value")


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    names = ", ".join(f"{c} string" for c in CLASHING)
    rows = [(i, t, None if k % 7 == 0 else f"s{k % 3}", "en", *["?"] * len(CLASHING)) for k, (i, t) in enumerate(odd_texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, lang string, {names}").repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("1 = 0")
