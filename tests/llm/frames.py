"""Small frames with the awkward rows that every operator has to stand."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Rows of (doc_id, text); the other columns are filled in, some with null."""
    full = [(i, t, None if n % 3 == 0 else "en", None if n % 4 == 0 else "src", len(t) if t is not None else None) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCUMENTS).repartition(2)


def clashing(df):
    """Extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    for name in ("class", "shingle", "score", "predicted", "word", "n", "place", "length", "uid", "ids", "all_spans", "component", "__id", "key"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four five six seven"),
    (6, "one two three four five six seven"), (6, "one two three four five six seven"), (None, "one two three four five six seven"),
    (7, "x" * 30_000), (8, "long words " * 8_000), (9, "Ünïcödé \U0001f600 text with odd space \x1c and\x85more"),
]
