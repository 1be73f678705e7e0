"""Small tables with every odd case, and plain versions of what the contracts call words."""

import random
import re

import pytest

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced_words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(ASCII_LOWER))


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(ASCII_LOWER))


def sentence(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """(doc_id, text): nulls, empties, blanks, short and long texts, copies, near copies, odd characters."""
    rng = random.Random(11)
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, None),
        (2, ""),
        (3, " \t\n\x0b "),
        (4, "One"),
        (5, "ONE"),
        (6, "two Words"),
        (7, base),
        (8, base),
        (9, " ".join(near)),
        (10, base + " " + sentence(rng, 5)),
        (11, sentence(rng, 4000, 9000)),
        (12, "x" * 30_000),
        (13, "Éa É b 日本語 🙂 ß, ok?"),
        (14, "a\x1cb  c\u0085d"),
        (None, base),
        (None, None),
        (15, "same"),
        (15, "same"),
    ]
    return rows + [(100 + i, sentence(rng, rng.randrange(1, 60))) for i in range(60)]


#: Names that the operators use inside.
CLASHING = ("score", "row", "words", "node", "bucket", "label", "block", "shard", "_range", "held", "size", "component")


@pytest.fixture(scope="session")
def documents(spark, odd_texts):
    names = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["?"] * len(CLASHING)) for r in odd_texts], f"doc_id long, text string, {names}").repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string")
