import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def sentence(g, n=12):
    return " ".join("".join(g.choice(["the", "on", "er", "ing", "at", "éa", "st", "re", "nd", "ou"]) for _ in range(g.randint(1, 3))) for _ in range(n)).capitalize() + "."


def prose(seed, n=14):
    g = random.Random(seed)
    return "\n".join(" ".join(sentence(g) for _ in range(3)) for _ in range(n // 3))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, copies, junk."""
    common = "A line that many documents share."
    passage = prose(999, 18).replace("\n", " ")
    rows = [(i, f"{common}\n{prose(i)}", "en", f"s{i % 3}") for i in range(12)]
    rows += [
        (20, None, None, None), (21, "", "en", "x"), (22, " \t\n\r\x0b ", "de", "x"), (23, "one", "fr", "x"), (24, "Ünï 漢字 \U0001f600 " * 40, "de", "x"),
        (25, prose(1), "en", "x"), (26, prose(1), "en", "x"), (26, prose(1), "en", "x"), (27, prose(2).replace("the", "teh", 1), "en", "x"),
        (28, "Der " * 3000, "de", "x"), (29, (prose(50, 60) + "\n") * 30, "en", "x"), (30, "x" * 50_000, "en", "x"), (31, "a@b.co " * 10 + "1.2.3.4 +1 (555) 010-9999", "en", "x"),
        (32, prose(60) + " " + passage + " " + prose(61), "en", "x"), (33, prose(62) + " " + passage + " " + prose(63), "en", "x"), (None, prose(70), "en", "x"), (None, common, None, "x"),
        (34, "|".join(["### $$$"] * 60), "en", "x"), (35, "\n".join([common.upper() + "  "] * 3), "en", "x"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def unique(spark, odd_rows):
    """The odd rows with one row for each doc_id, none null."""
    seen = {r[0]: r for r in odd_rows if r[0] is not None}
    return spark.createDataFrame(list(seen.values()), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
