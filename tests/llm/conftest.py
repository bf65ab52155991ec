import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, copies and looping text."""
    rng = random.Random(3)
    base = [" ".join(words(rng, 120, 5000)) for _ in range(12)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(20, base[0], "en", "src0", len(base[0])), (21, base[1].replace(" ", "\n", 3) + " extra", "de", "src0", 0)]
    rows += [(22, base[2][: len(base[2]) // 2] + " " + base[3][len(base[3]) // 2 :], "fr", "src1", 9), (23, base[4], None, None, None)]
    rows += [(30, None, "en", "src0", None), (31, "", "en", "src0", 0), (32, " \t\n", None, "src9", 3), (None, base[5], "en", None, 5), (None, None, None, None, None)]
    rows += [(33, "la " * 200, "es", "src2", 600), (34, "la " * 150 + base[6], "es", "src2", 1), (35, " ".join(words(rng, 20000, 50000)), "en", "src2", 2)]
    rows += [(36, "x" * 50000, "en", "src2", 3), (37, "Straße naïve 日本語 \x00 end", "de", "s\x00rc", 4), (37, "other text of the same id", "de", "src", 4)]
    rows += [rows[0], rows[0], (38, "!!! ### 123 $$$", "en", "src4", 4)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Columns named as results and helpers are."""
    from pyspark.sql import functions as F

    names = "key gram at words start stop spans ref_doc_id shard __key bucket batch slot hi lo fingerprint group_id kept n_tokens token_ids n_private job host keep rejected share media stream d t m u v node root bytes".split()
    return odd.select("*", *[F.lit("x").alias(n) for n in names])
