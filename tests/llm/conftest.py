import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves: columns of the input that have them must not get in the way.
CLASHES = "size long, kept boolean, ids string, decoded string, n_words long, key long, spans string, email string, start long, mark string, set long, class_id long, digest string, score double, __text string, __at long, at long, rank int, part int, bucket string, missing long, before long, words long, low int, root long"


def prose(rnd: random.Random, n: int) -> str:
    words = ["the", "of", "tion", "äre", "sch", "idiot's", "Été", "12", "a,b", "x.y"]
    return " ".join("".join(rnd.choice(words) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward_rows():
    rnd = random.Random(5)
    long = prose(rnd, 40_000)
    plain = prose(rnd, 120)
    texts = [None, "", " \n\t ", "one", "a b c d", plain, plain, plain + "\n", plain + " end", prose(rnd, 60), long, long, "x" * 150_000, "ab " * 500, "line\nline\n\nother\nline", "漢字 😀 <|endoftext|> it's 'll", "don't\r\nstop"]
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", i) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, plain, None, None, None), (None, None, None, None, None), (99, None, "en", "s0", 0)]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def clashing(spark, awkward):
    from pyspark.sql import functions as F

    for part in CLASHES.split(", "):
        name, kind = part.split()
        awkward = awkward.withColumn(name, F.lit(None).cast(kind))
    return awkward


@pytest.fixture(scope="session")
def landed(spark, awkward, empty, tmp_path_factory):
    """Folders with a documents.parquet: the awkward rows, and none."""
    out = {}
    for name, df in (("awkward", awkward), ("empty", empty)):
        out[name] = str(tmp_path_factory.mktemp(name))
        df.write.parquet(f"{out[name]}/documents.parquet")
    return out
