"""Rows with all that can be odd about documents."""

LONG = " ".join(f"w{i}" for i in range(30_000))
PROSE = "the quick brown fox jumps over the lazy dog while seven other animals look on from the old bridge"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, label string, id string"
ODD = [
    (0, None, None, None),
    (1, "", "en", ""),
    (2, " \n\t ", "en", "a"),
    (3, PROSE, "en", "a"),
    (4, PROSE, "de", "a"),
    (4, PROSE, "de", "a"),
    (5, PROSE + " today", None, None),
    (6, LONG, "en", "b"),
    (7, "one two", "en", "b"),
    (8, "one two", "en", "b"),
    (9, "日本語 テキスト 😀\nx\x0by", "ja", "c"),
    (10, "\n".join([PROSE] * 3), "en", "c"),
    (None, PROSE, "en", "c"),
]


def rows(spark, data):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), "clash", "clash", "clash") for i, t, lang, source in data], DOCS)
