"""Small tables with the awkward cases every operator must take: nulls, empty and long texts, ties, repeated rows, and
further columns whose names clash with those that the operators use inside."""

from pyspark.sql import functions as F

CLASHES = ["key", "marks", "rank", "kept", "root", "score", "length", "row", "_id", "_norm", "sha", "value"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, source) with clashing columns."""
    full = [(r[0], r[1], None if r[0] and r[0] % 3 == 0 else "en", r[2] if len(r) > 2 else "src0", None) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    return df.withColumns({c: F.lit(f"x{c}") for c in CLASHES})


AWKWARD = [(1, "one two  three four five six"), (2, "one two three\tfour five six"), (2, "one two three\tfour five six"),
           (3, None), (4, ""), (5, " \n "), (None, "alone without an id"), (None, None), (6, "!!! ???"), (7, "x"),
           (8, "very long " * 20000), (9, "y" * 100000), (10, "Zeichen ä 漢字 😀 end <|endoftext|> tail")]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()),
                  key=lambda r: tuple((v is not None, str(type(v)), v) if not isinstance(v, (int, float)) else (True, "n", v)
                                      for v in r))
