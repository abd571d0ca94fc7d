"""Parameter lists as tables."""

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


def small_table(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """A table of literal rows whose size Spark knows, so it decides itself whether to broadcast it."""
    columns = {}
    for place, field in enumerate(ddl.split(", ")):
        name, dtype = field.split(" ")
        columns[name] = pa.array([row[place] for row in rows], _TYPES[dtype])
    return spark.createDataFrame(pa.table(columns))
