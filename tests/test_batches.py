"""Python tasks of library queries get whole texts by bytes, however many rows a task has."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom import session


@F.pandas_udf(T.LongType())
def _bytes(texts: pd.Series) -> pd.Series:
    return pd.Series([int(texts.str.len().sum())] * len(texts))


def test_batches_are_bounded_by_bytes(spark):
    rows = session.prepare(spark).range(0, 9_000, 1, 1).select(F.concat(F.repeat(F.lit("x"), 4_000), F.col("id").cast("string")).alias("t"))
    assert rows.select(_bytes("t").alias("n")).agg(F.max("n")).first()[0] < 8 << 20
