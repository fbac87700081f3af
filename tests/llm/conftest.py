import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

PROSE = (
    "the quick brown fox jumps over the lazy dog while seven wizards brew a potion of sage and thyme near an old "
    "stone bridge that no traveller has crossed since the flood of the year before last when the miller lost his wheel"
).split()


@pytest.fixture(scope="session")
def cases():
    """(doc_id, text, lang, source): nulls, empty and long texts, ties, repeated rows and copies."""
    base = " ".join(PROSE)
    near = base.replace("lazy", "sleepy")
    long_ = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    other = "entirely different words make this line stand alone among its many friends and foes today"
    rows = [
        (1, base, "en", "b"), (2, base, "en", "b"), (2, base, "en", "b"), (3, near, "en", None), (4, None, "de", "a"), (5, "", None, "a"),
        (6, "   \n\t ", "de", "a"), (7, "one", "en", "c"), (8, long_, "fr", "c"), (None, base, None, None), (None, None, None, None),
        (9, f"{other}\n{other}\nextra", "fr", "é"), (10, "A B C D a b c d # $ %% ||", "fr", "é"), (11, base + " tail   Ünï 😀 #", "fr", "z"),
        (12, "spam " * 40, "en", "z"), (12, other, "en", "z"), (13, (base + " ") * 3, "en", "zz"),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, cases):
    """The cases with columns whose names clash with those of results."""
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(cases, schema).repartition(3)
    extra = {n: f"'{n}'" for n in ("n_words", "h", "size", "kept", "slot", "shard", "fp", "mark", "component_id", "start", "score", "tokens", "target", "its_source", "mix_copies", "mix_time", "mix_times", "_held_id", "_held_text", "stratum", "pooled", "times", "proposes")}
    return df.selectExpr("*", *[f"{v} AS {n}" for n, v in extra.items()])


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")
