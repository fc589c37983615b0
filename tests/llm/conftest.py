import pytest

AWKWARD = [
    (1, None, "en", "src0", None),
    (2, "", "en", "src0", 0),
    (3, "   \n\t ", None, None, 3),
    (4, "one two three four five " * 60, "en", "src1", 1440),
    (4, "one two three four five " * 60, "en", "src1", 1440),
    (5, "one two three four five " * 60, "en", "zzz", 1440),
    (None, "no id here but quite a few words in it all the same, you see", "en", "src0", 60),
    (None, None, None, None, None),
    (6, "é" * 5000 + " ok\n" + "x " * 3000, "fr", "src7", 11003),
    (7, "Word! " * 40_000, "en", "src2", 240_000),
    (-8, " nbsp inside\x0bvertical\x0cfeed\rreturn", "de", "src3", 36),
    (2**62, "a b c\na b c\na b c\n", "es", "src4", 18),
]
#: Columns whose names the operators use themselves.
CLASH = ["slot", "h", "share", "block", "key", "u1", "fp", "n_words", "score", "root", "row", "text_crc32", "__n", "p_from", "name"]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls everywhere, repeats, long texts and clashing columns."""
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH]).cache()


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet").cache()
