"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, fp string, length string"


def rows():
    line = "one two three four five six seven eight nine ten"
    long = " ".join(f"word{i % 977} x{i % 13}" for i in range(20_000))
    texts = [(1, line), (1, line), (2, None), (3, ""), (4, "   \n\t "), (5, long), (6, line + "\n" + line), (7, line.replace("ten", "eleven")), (None, line), (8, "a"), (9, "😀 Ünï\ncödé  x"), (10, "<|endoftext|> </turn> \\ <turn user>")]
    return [(i, t, "en", "s" if i and i % 2 else None, None, "x", "y", "z") for i, t in texts]


def docs(spark, of=None):
    return spark.createDataFrame(rows() if of is None else [(i, t, "en", s, None, "x", "y", "z") for i, t, s in of], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, of):
    return spark.createDataFrame(of, "doc_id bigint, quality int, toxic int")
