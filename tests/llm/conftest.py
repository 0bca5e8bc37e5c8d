import pytest

#: Texts with what tends to break operators.
LONG = "word" + " lorem ipsum dolor sit amet" * 20_000
TEXTS = [None, "", "   \t\n", "a", "one two three", "tie tie tie tie tie tie", "x" * 300_000, LONG, LONG + " end", "\x0b\x0cvt ff\x85nel\xa0nbsp", "é😀 ü﻿  ß", "</s>[INST] <|endoftext|>", "a", "one  two\nthree"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns with names that operators use inside."""
    rows = [(i, t, "src" if i % 3 else None, "v") for i, t in enumerate(TEXTS)]
    rows += [rows[4], (5, "another text of five words here", "src", "v"), (None, "a", "z", "v"), (None, None, None, None)]
    names = "doc_id long, text string, source string, lang string"
    extra = ["row", "key", "th", "doc", "n", "size", "score", "predicted", "id", "bucket", "group_size", "kept", "block", "h", "taken", "spans", "base", "_th", "_text", "_texts", "_begin", "_taken", "_size", "_id", "_h", "_key", "_gone_key", "_gone_id", "_slot", "_copy", "_tox_score", "x0", "skey", "component"]
    df = spark.createDataFrame(rows, names)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in extra})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def by_id(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out
