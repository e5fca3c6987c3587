"""Small tables with awkward rows."""

LONG = "word " * 30_000


def documents(spark, rows=None):
    """doc_id, text and columns whose names clash with those the operators use inside."""
    if rows is None:
        rows = [
            (1, "The quick brown fox jumps over the lazy dog. It was late.\nNobody saw it."),
            (2, None), (3, ""), (4, "   \n\t "), (5, LONG), (6, "Ünïcödé — 中文字符 😀 test"), (7, "a"), (7, "a"), (8, "x" * 5000),
            (9, "<|endoftext|> inside"), (10, "The quick brown fox jumps over the lazy dog. It was late.\nNobody saw it."),
        ]
    return spark.createDataFrame([(i, t, (i or 0) % 3, "n", 5) for i, t in rows], "doc_id long, text string, key int, lang string, n long")


def empty(spark):
    return documents(spark).where("false")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
