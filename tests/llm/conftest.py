import random
import zlib

import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators add themselves.
CLASHES = ["size", "shard", "score", "predicted", "n_tokens", "bits", "key", "component", "spans", "kept", "row", "h", "label"]


def words(rng, n, vowels="aeiou"):
    return [rng.choice("bcdfghklmnprstvz") + rng.choice(vowels) + rng.choice(["", "n", "r", "st", "lo", "mi"]) + rng.choice(["", "ta", "re"]) for _ in range(n)]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, **more):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", f"src{k % 3}", len(t) if t is not None else None) for k, (i, t) in enumerate(zip(ids, texts))]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """NULL, empty, blank, very long, one huge word, marks, other scripts, ties and copies."""
    rng = random.Random(4)
    long = " ".join(words(rng, 9000))
    base = " ".join(words(rng, 60))
    return [None, "", " \t\n", long, "x" * 5000, "?!... ###", "Ünï çødé 漢字 😀 ▁x", base, base, base + " end", "A", "The\x0bend\x1c of it"]


@pytest.fixture(scope="session")
def clashing():
    from pyspark.sql import functions as F

    def add(docs):
        for name in CLASHES:
            docs = docs.withColumn(name, F.lit("own"))
        return docs

    return add


def crc(i):
    return zlib.crc32(str(i).encode())


__all__ = ["Row", "crc", "words"]
