"""Output names without collisions."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def without_collisions(rows: DataFrame, candidate: str, order: list, name: str = "file_name", fold_case: bool = False) -> DataFrame:
    """The nth row (from 0, in order) of a candidate name gets ``_n`` before the last dot, none for n = 0."""
    key = F.lower(candidate) if fold_case else F.col(candidate)
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    c = F.col(candidate)
    dotted = c.rlike(r"(?s)^.+\.[^.]*$")
    suffix = F.concat(F.lit("_"), F.col("lc_nth").cast("string"))
    with_dot = F.concat(F.regexp_extract(c, r"(?s)^(.+)(\.[^.]*)$", 1), suffix, F.regexp_extract(c, r"(?s)^(.+)(\.[^.]*)$", 2))
    made = F.when(F.col("lc_nth") == 0, c).otherwise(F.when(dotted, with_dot).otherwise(F.concat(c, suffix)))
    return rows.withColumn("lc_nth", n).withColumn(name, made).drop("lc_nth")


def first_wins(rows: DataFrame, key: Column, order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("lc_key", key).withColumn("lc_nth", F.row_number().over(Window.partitionBy("lc_key").orderBy(*order))).where("lc_nth = 1").drop("lc_key", "lc_nth")


def nfc(text: Column) -> Column:
    """Unicode normal form C (no JVM function has it, so in Arrow batches)."""
    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return normal(text)
