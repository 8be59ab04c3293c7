"""Category codes and feature scaling. Fitted state is data, so it can be saved and joined."""

from pyspark.sql import DataFrame, functions as F

from accesslens import constants as C
from accesslens.plans.lookup import BROADCAST_ROWS, salted_left_join, small_rows
from accesslens.plans.ranks import dense_codes
from accesslens.plans.tables import local_table
from accesslens.functions.scalar import lookup_map, repaired


class CategoryEncoder:
    """Code of a value = rank among the sorted distinct training values; unseen values get -1."""

    def __init__(self, spark, small, large):
        self.spark = spark
        self.small = small      # column -> [(value, code)], proven to be short
        self.large = large      # column -> DataFrame(value, code)

    @classmethod
    def fit(cls, df: DataFrame, columns, limit=BROADCAST_ROWS):
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns]))
        words = df.select(pairs.alias("p")).select("p.c", "p.v").where("v is not null").distinct()
        rows = small_rows(words, limit)
        if rows is None:
            return cls(df.sparkSession, {}, {c: dense_codes(df, c) for c in columns})
        small = {c: [] for c in columns}
        for r in sorted(rows, key=lambda r: (r["c"], r["v"])):
            small[r["c"]].append((r["v"], len(small[r["c"]])))
        return cls(df.sparkSession, small, {})

    @classmethod
    def of(cls, dictionaries):
        """An encoder from stored dictionaries: column -> DataFrame (value, code)."""
        spark = next(iter(dictionaries.values())).sparkSession
        held = {c: small_rows(d) for c, d in dictionaries.items()}
        return cls(spark, {c: [(r[c], r["code"]) for r in rows] for c, rows in held.items() if rows is not None},
                   {c: dictionaries[c] for c, rows in held.items() if rows is None})

    def dictionary(self, column) -> DataFrame:
        if column in self.large:
            return self.large[column]
        return local_table(self.spark, self.small[column], f"{column} string, code long")

    def transform(self, df: DataFrame, outputs, spread_by="event_id"):
        """``outputs``: column -> name of the code column."""
        for column, name in outputs.items():
            codes = self.dictionary(column).withColumnRenamed("code", "_code")
            if column in self.large:
                df = salted_left_join(df, codes, column, spread_by)
            else:
                df = df.join(F.broadcast(codes), column, "left")
            df = df.withColumn(name, F.coalesce("_code", F.lit(-1)).cast("long")).drop("_code")
        return df


def label_code(label="label"):
    """Code of one of the eight fixed labels, -1 for any other text; normal is the largest code."""
    return F.coalesce(F.try_element_at(lookup_map(C.LABEL_CODES), F.col(label)), F.lit(-1)).cast("long")


def label_name(code):
    names = {v: k for k, v in C.LABEL_CODES.items()}
    return F.coalesce(F.try_element_at(lookup_map(names), F.col(code).cast("int")), F.lit("unknown"))


def fit_scaler(df: DataFrame, features) -> DataFrame:
    """Mean and population deviation of each repaired feature, as one row; a zero deviation becomes 1."""
    aggs = []
    for f in features:
        x = repaired(F.col(f))
        aggs += [F.avg(x).alias(f"{f}__mean"), F.stddev_pop(x).alias(f"{f}__std")]
    row = df.agg(*aggs)
    return row.select(*[
        c for f in features for c in (
            F.col(f"{f}__mean"), F.when(F.col(f"{f}__std") == 0, 1.0).otherwise(F.col(f"{f}__std")).alias(f"{f}__std"))])


def scale(df: DataFrame, stats: DataFrame, features, suffix="_z") -> DataFrame:
    """(x - mean) / deviation with the statistics of ``fit_scaler`` (one row, broadcast)."""
    wide = df.crossJoin(F.broadcast(stats))
    z = [((repaired(F.col(f)) - F.col(f"{f}__mean")) / F.col(f"{f}__std")).alias(f + suffix) for f in features]
    return wide.select(*df.columns, *z)


def minmax_inverted(df: DataFrame, column, name) -> DataFrame:
    """1 - (x - min) / (max - min) over exactly this frame; 0.5 where all values are equal."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    value = F.when(span > 0, 1 - (F.col(column) - F.col("_lo")) / span).otherwise(0.5)
    return df.crossJoin(F.broadcast(ends)).withColumn(name, value).drop("_lo", "_hi")
