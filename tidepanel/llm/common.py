"""Helpers shared by the operators: row identity, tables, row-wise Arrow maps, numbering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: White space between words: the characters [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: Stands for a null id inside the jobs, so that such rows join and sort like any other.
NULL_ID = -(2**63)
#: Rows turned into Python objects at a time; bounds a worker's memory, not the result.
ROWS_AT_ONCE = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identified(df: DataFrame, *columns: str, id_col: str = "doc_id") -> DataFrame:
    """Only the id, as a long named ``id`` without nulls, and ``columns``; other columns cannot clash."""
    return df.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("id"), *[F.col(f"`{c}`") for c in columns]
    )


def given_id(column: str = "id") -> Column:
    """The id as it was given: null again where it was null."""
    return F.when(F.col(column) != NULL_ID, F.col(column))


def mapped(df: DataFrame, make: Callable[[], Callable], schema: str | T.StructType) -> DataFrame:
    """One output row per input row through a Python function that ``make`` builds once per task.

    Rows pass as Arrow batches and become Python objects a few at a time.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        function = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                columns = [c.to_pylist() for c in batch.slice(at, ROWS_AT_ONCE).columns]
                rows = [function(*row) for row in zip(*columns)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow
                )

    return df.mapInArrow(run, kind)


def many(df: DataFrame, make: Callable[[], Callable], schema: str | T.StructType) -> DataFrame:
    """Any number of output rows per input row: the function returns a list of tuples."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        function = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                columns = [c.to_pylist() for c in batch.slice(at, ROWS_AT_ONCE).columns]
                rows = [out for row in zip(*columns) for out in function(*row)]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow
                    )

    return df.mapInArrow(run, kind)


def numbered(df: DataFrame, name: str, order: list[str], within: list[str] | None = None, pieces: int = 64) -> DataFrame:
    """A gapless number from 0, per ``within`` group, that depends only on the rows.

    Rows are split into pieces by a hash of ``order``; a window numbers each piece and the pieces'
    sizes, few in number, are summed up.  No group is sorted in one task.
    """
    within = within or []
    split = df.withColumn("_piece", F.pmod(F.xxhash64(*order), F.lit(pieces)).cast("int"))
    sizes = split.groupBy(*within, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn(
        "_before",
        F.coalesce(
            F.sum("_n").over(
                Window.partitionBy(*(within or [F.lit(0)])).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    ).drop("_n")
    keys = [*within, "_piece"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return (
        split.withColumn("_place", place.cast("long"))
        .join(before, keys)
        .withColumn(name, F.col("_place") + F.col("_before"))
        .drop("_piece", "_place", "_before")
    )
