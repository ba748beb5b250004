"""Rows of a documents table built by hand."""

from pyspark.sql import types as T


def make_docs(spark, rows, extra=()):
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
         T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in extra]
    )
    full = [(i, t, "en", "src0", None if t is None else len(t), *("x" for _ in extra)) for i, t in rows]
    return spark.createDataFrame(full, schema)
