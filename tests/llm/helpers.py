"""Small fixtures shared by the tests of the training-data operators."""

import random

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns with clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again. " * 4, "en", "a", 1),
        (2, "The  quick\tbrown fox jumps over the lazy dog again and again. " * 4, "en", "a", 1),
        (2, "The  quick\tbrown fox jumps over the lazy dog again and again. " * 4, "en", "a", 1),
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (4, " \t\n", None, "b", 0),
        (None, "der schnelle braune Fuchs springt über den faulen Hund und läuft davon in den Wald hinein", "de", "b", 5),
        (None, None, None, None, None),
        (5, "12345 67890 $$$", "en", "b", 3),
        (6, "naïve café \U0001f600 " * 3000, "fr", "c", 9),
        (7, "x" * 30000, None, "c", 7),
        (8, "word", "en", "c", 4),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("rid", "n", "shard", "spans", "_rid", "_spans", "hash", "idx", "key"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(seed, n=60, letters="abcdefgé"):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 7))) for _ in range(n)]
