import random

import pytest


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(("the", "tion", "and", "ing", "er", "on", "re", "eau", "ß", "é")) + rng.choice(("a", "o", "sh", "nd", "")) + str(rng.randint(0, 9)) for _ in range(n))


LONG = prose(99, 6000)
#: Nulls, empty and long texts, repeated rows, one key with two texts, copies and near copies.
ROWS = [
    (1, prose(1, 120), "s0"), (2, prose(1, 120), "s0"), (3, prose(1, 120) + " changed", None), (4, prose(4, 80), "s1"), (5, None, "s1"), (6, "", "s1"), (6, "", "s1"),
    (7, "One TWO three", "s2"), (8, "one two three", "s2"), (9, prose(9, 300), "s0"), (9, prose(10, 200), "s0"), (None, prose(4, 80), "s0"), (None, None, None), (10, LONG, "s0"), (11, " \t\n ", "s0"),
]
#: Columns whose names the operators could use inside.
CLASHES = ("key", "row_key", "w", "_cell", "shard", "n", "node", "ids", "text_crc32", "rank")


@pytest.fixture(scope="session")
def edge_docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    for c in CLASHES:
        df = df.selectExpr("*", f"'x' AS `{c}`")
    return df.cache()


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
