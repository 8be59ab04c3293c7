"""Short literal tables as local relations (no Python worker in the plan)."""

import pyarrow as pa

_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def local_table(spark, rows, schema):
    """``schema`` is ``"name type, ..."`` with string, long, int, double or boolean columns."""
    fields = [part.split() for part in schema.split(",")]
    data = list(zip(*rows)) if rows else [[] for _ in fields]
    arrays = [pa.array(list(values), _ARROW[kind]) for values, (_, kind) in zip(data, fields)]
    table = pa.table(arrays, names=[name for name, _ in fields])
    return spark.createDataFrame(table)
