"""Small shared helpers for operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every floating column (half even) for engine-independent comparison."""
    scale = float(10**places)
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append((F.rint(F.col(f.name) * scale) / scale).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def share(cond) -> "F.Column":
    """Share of rows where ``cond`` holds; null counts as false (D3)."""
    return F.avg(F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0)))


def with_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row. The one row is
    broadcast; Spark folds the constant key and plans a nested loop over it."""
    return (df.withColumn("_one", F.lit(1))
            .join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one"))
