import random
import zlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, score string, h string"


def prose(rng, n, words=("the", "quick", "brown", "fox", "jumps", "over", "lazy", "dog", "and", "runs", "far", "away", "from", "here")):
    return " ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Ordinary texts, then nulls, empties, white space, a very long text, exact and
    near copies, a repeated row, a null id and columns with clashing names."""
    rng = random.Random(5)
    made = [(i, prose(rng, rng.randint(60, 200)), rng.choice(["en", "de"]), rng.choice(["a", "b", "c"])) for i in range(60)]
    long = prose(rng, 30_000)
    copy = made[3][1]
    near = copy.replace(copy.split()[10], "changed", 1)
    made += [(100, None, "en", "a"), (101, "", None, "b"), (102, " \t\n\x0b\f\r ", "de", None), (103, long, "en", "a"), (104, copy, "en", "a"), (105, copy, None, None), (106, near, "en", "b"), (7, made[7][1], made[7][2], made[7][3]), (None, "a text without an id, of a few words", "en", "a"), (107, "Ünïcode ẞ 🤦🏼‍♂️ Größe 漢字 kana", "de", "c"), (108, "x" * 200_000, "en", "c"), (109, "one", "de", "b")]
    return [(*r, len(r[1]) if r[1] is not None else None, "clash", "clash", "clash", "clash") for r in made]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def crc(doc_id, parts):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts
