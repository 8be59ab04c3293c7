"""Dictionary lookups whose broadcast side is checked, with a salted join beyond the limit."""

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 50_000
SALTS = 64


def small_rows(df: DataFrame, limit=BROADCAST_ROWS):
    """The rows of ``df`` if there are at most ``limit`` of them, else None. Reads at most limit + 1 rows."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def salted_left_join(df: DataFrame, dim: DataFrame, key, spread_by, salts=SALTS) -> DataFrame:
    """Left join on ``key`` where one key may own a large share of ``df``: its rows spread over ``salts``."""
    many = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    return df.withColumn("_salt", salt).join(many, [key, "_salt"], "left").drop("_salt")
