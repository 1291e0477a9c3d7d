"""Small documents with the cases every operator must stand: null, empty, long, repeated, tied, with clashing columns."""

from pyspark.sql import functions as F

LONG = " ".join(f"wort{i % 977}x{i}" for i in range(20_000))
PASSAGE = " ".join(f"phrase{i}" for i in range(60))
TEXTS = [
    (1, "The cat sat on the mat and the dog lay by the door of the old house near the river bank", "en", "a"),
    (2, "The cat sat on the mat and the dog lay by the door of the old house near the river bank", "en", "a"),
    (3, None, "en", None),
    (4, "", None, "b"),
    (5, " \t\n\x0b ", "de", "b"),
    (6, LONG, "de", "c"),
    (7, "einzig " + PASSAGE + " ende eins", "de", "c"),
    (8, "anders " + PASSAGE + " schluss zwei", "de", "c"),
    (None, "no id here but some words to keep", "en", "d"),
    (9, "eins", "de", "d"),
    (9, "eins", "de", "d"),
    (10, "Ünïcödé wörds — “quoted” 漢字 and\u00a0hard\u2003spaces 12345 #*$%&|<>", None, "e"),
    (11, "a b c d e a b c d e a b c d e", "en", "e"),
    (12, "line one\nline one\n\nline two\nline one", "en", "e"),
    (13, "  two  spaces   three\n \n tail ", "en", "e"),
]


def documents(spark, clash=()):
    """The documents above; ``clash`` adds text columns of these names."""
    df = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in clash}) if clash else df


def empty(spark):
    return documents(spark).limit(0)
