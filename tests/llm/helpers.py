"""Inline tables for the operators' tests."""

DOCS = "doc_id long, text string"


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
