"""Small tables shared by the tests of the training-data operators."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, schema=SCHEMA):
    """A table of documents from (doc_id, text, ...) tuples, missing columns null."""
    width = len(schema.split(","))
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)


def clashing(df):
    """The table with columns whose names operators use for results or on the way."""
    from pyspark.sql import functions as F

    names = "fp first n root size key shard seats rank score label term row item hash block hits __x text2".split()
    return df.select("*", *[F.lit("x").alias(c) for c in names if c not in df.columns])


def by_id(df, id="doc_id"):
    return {r[id]: r for r in df.collect()}
