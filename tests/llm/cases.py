"""Tables of odd rows that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, hubs string, _may string, size string, begin string, cell string, marks string, label string"
LOREM = "The first sentence stands here with several words. A second one follows it closely with more words. The third closes the passage for all of us. "


def docs(spark, rows):
    """rows: (doc_id, text, lang, source), with columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(*r, 0, *["x"] * 8) for r in rows], DOCS)


ODD = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, "   \n\t ", None, None),
    (4, "!!! ... ###", "en", None),
    (None, LOREM, "en", "a"),
    (5, LOREM, "en", "b"),
    (5, LOREM, "en", "b"),
    (6, LOREM, None, "b"),
    (7, LOREM + "A tail that differs.", "en", None),
    (8, "one", "en", "c"),
    (9, "Ünïcödé wörds 한글 مرحبا \U0001f600 \x00 end.", "de", "c"),
    (10, "word " * 30000, "en", "a"),
    (11, "a" * 100000, "en", "a"),
    (12, "mail a@b.co card 4111 1111 1111 1111", "en", "a"),
]
