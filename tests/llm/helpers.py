"""Awkward documents that every text operator meets."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977} is here, and é too" for i in range(20_000))


def awkward(spark, extra="1 AS h, 2 AS rank, 'x' AS position, 3 AS block"):
    rows = [
        (1, "Plain words stand in this line.\nAnd a second line follows it.", "en", "a", 10),
        (1, "Plain words stand in this line.\nAnd a second line follows it.", "en", "a", 10),
        (2, None, "en", None, None),
        (3, "", None, "a", 0),
        (4, " \n\t ", "de", "b", 4),
        (None, "No id but a text, with an emoji \U0001f600 and ﬁ.", "en", "b", None),
        (None, None, None, None, None),
        (5, LONG, "en", "a", len(LONG)),
        (6, "Grüße aus Köln, die Straße ist lang und das Wetter ist gut.", "de", "c", 60),
    ]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", *[e.strip() for e in extra.split(",")])


def empty(spark):
    return spark.createDataFrame([], DOCS)
