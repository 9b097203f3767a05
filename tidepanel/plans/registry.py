"""The query registry: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions.numeric import fixed
from tidepanel.plans.inputs import Dataset

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str, level: str = "nation"):
    """Register a query written against a Dataset."""

    def register(fn: Callable[[Dataset], DataFrame]):
        REGISTRY[name] = lambda spark, sf_dir: fn(Dataset(spark, sf_dir, level))
        return fn

    return register


#: Fractional columns that Spark may still round in one method; more of them make it too long for the JIT.
MOST_FUSED = 24


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every fractional column so that engines agree to the last digit.

    Spark fuses a projection into one method, which the JIT leaves interpreted beyond 8,000 bytes.  Higher-order
    functions are not fused: with one of them a wide projection is compiled on its own, in short methods.
    """
    fractional = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType))]
    apart = fractional[0] if len(fractional) > MOST_FUSED else None

    def told(name: str) -> Column:
        value = F.col(f"`{name}`").cast("double")
        return F.transform(F.array(value), lambda v: fixed(v, digits))[0] if name == apart else fixed(value, digits)

    return df.select(*[told(f.name).alias(f.name) if f.name in fractional else F.col(f"`{f.name}`") for f in df.schema])


def as_double(df: DataFrame, *columns: str) -> DataFrame:
    """Integers that may be null leave as doubles, the one type with a null in every client."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})
