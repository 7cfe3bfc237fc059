"""Small document tables for the tests: nulls, empty and long texts, repeated rows, clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, extra=""):
    rows = [(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in extra.split():
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("x"))
    return df


ODD = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one two three"), (5, "Ünï cödé ½ \U0001f600 text here"), (6, "x" * 50_000), (7, "same row here now"), (7, "same row here now"), (None, "no id at all here"), (9, "a b " * 30_000)]
