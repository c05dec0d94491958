from __future__ import annotations

import pytest

# A hot text, near copies, a shared passage, odd white space, nulls, repeats and a long text.
PASSAGE = " ".join(f"shared{i}" for i in range(30))


def sentence(start: int, n: int) -> str:
    return " ".join(f"w{start * 1000 + i}" for i in range(n))


def rows() -> list[tuple]:
    base = sentence(1, 120)
    near = base.replace("w1005 ", "changed ")
    out = [
        (1, base, "en", "a", len(base)), (2, base, "en", "b", len(base)),
        (3, near, "en", "a", len(near)), (4, None, None, None, None), (5, "", "en", "a", 0),
        (6, "  \n\t ", "en", "a", 5), (7, "two words", "en", "a", 9), (7, "two words", "en", "a", 9),
        (None, "no id here", "en", "a", 10),
        (8, sentence(2, 60) + " " + PASSAGE, "en", "a", 1), (9, PASSAGE + "\n" + sentence(3, 60), "en", "a", 1),
        (10, "loop it again and again " * 60, "en", "a", 1), (11, sentence(4, 9000), "fr", "c", 1),
        (12, "Ünïcode İstanbul ΣΑΣ ﬁ x́ <|endoftext|> it's 12½", "xx", "d", 1)]
    out += [(100 + i, "hot text of the corpus", "en", "hot", 22) for i in range(40)]
    out += [(200 + i, sentence(10 + i, 25 + i), "en", f"s{i % 3}", 1) for i in range(30)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents in several partitions, with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), SCHEMA).repartition(5, "source")
    for name in ("digest", "bucket", "keep_id", "component", "rank", "size", "starts", "_keep", "own_digest", "gone_id", "removal_starts"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
