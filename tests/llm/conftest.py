import random
import re

import pytest

#: Names that operators use inside.
CLASHES = ["row", "t", "w", "doc", "tk", "n", "regs", "h", "g", "bucket", "found", "no", "line", "key", "ids", "data", "id", "set", "hits", "text_", "row_"]


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, repeats, odd characters, and all that is empty."""
    rng = random.Random(7)
    vocabulary = ["the", "of", "and", "le", "la", "der", "que", "é", "ñandú", "x1", "end.", "A-b", "Ünï", "😀", "don't"] + [f"w{k}" for k in range(60)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = make(60)
    out = [make(rng.randint(1, 120)) for _ in range(30)]
    out += [out[3], out[3], out[4] + "\n" + passage, make(20) + "\n" + passage + "\n" + make(9), passage.upper(), passage.replace(" ", "\t\n ", 4)]
    base = make(90).split()
    for _ in range(25):
        near = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        out.append(" ".join(near))
    out += ["", " ", "\n\n", None, "x", "a b c d", "a" * 5000, "der " * 400, "\u0000\x1c a\x85b c", make(3000), "\n".join([make(12)] * 4 + ["ab"] * 3)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as a table with clashing columns; ids are not in order, one is null."""
    from pyspark.sql import functions as F

    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    rows = [(None if k == 5 else i, t, ["en", "de", None, "xx"][k % 4]) for k, (i, t) in enumerate(zip(ids, texts))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    return df.select("*", *(F.lit(1).alias(c) for c in CLASHES))


@pytest.fixture(scope="session")
def plain(docs):
    """(doc_id, text) pairs as the driver sees them."""
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
