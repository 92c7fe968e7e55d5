"""Small documents with every awkward case."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed: int = 1, n: int = 24) -> list[str]:
    rng = random.Random(seed)
    words = ["the", "of", "and", "house", "tree", "river", "stone", "cloud", "to", "bird", "in", "is", "light"]
    return ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(5, 14))).capitalize() + "." for _ in range(rng.randint(1, 9))) for _ in range(n)]


def documents(spark, extra=()):
    base = texts()
    rows = [(k, t, ("en", "de", None)[k % 3], f"src{k % 4}", len(t)) for k, t in enumerate(base)]
    rows += [
        (100, None, "en", "src0", None),
        (101, "", "en", None, 0),
        (102, " \n\t ", None, "src1", 4),
        (103, "12 34 !!", "en", "src1", 8),
        (104, base[0], "en", "src2", len(base[0])),
        (0, base[0], "en", "src0", len(base[0])),
        (105, base[1] + " tail", "de", "src3", None),
        (None, base[2], "en", "src2", 1),
        (None, None, None, None, None),
        (106, "word " * 3000, "en", "src9", 15000),
        (107, "one two", "en", "é", 7),
    ]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
