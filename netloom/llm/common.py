"""What the operators of this subpackage share: tables, word pattern, row keys."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from netloom.session import new_folder

#: A word is a run of anything but a space and the five ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns of ``keyed``; the double underscore keeps them apart from the columns of a table.
ID, TEXT_ID = "__id", "__text_id"
LAST_ID = 2 ** 63 - 1


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ID (the id; missing ones come last) and TEXT_ID (64-bit hash; a NULL text is empty).

    Together they tell rows apart that share an id, or have none, but differ in text.
    """
    return docs.withColumns({ID: F.coalesce(F.col("doc_id"), F.lit(LAST_ID)),
                             TEXT_ID: F.xxhash64(F.coalesce("text", F.lit("")))})


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable[..., Iterable[tuple]]]) -> DataFrame:
    """Rows made by ``start()(*row)`` in Arrow batches; ``start`` runs once a task, rows are few at a time."""
    out = StructType.fromDDL(schema)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, make = to_arrow_schema(out), start()

        def batch(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)], schema=arrow)

        rows: list[tuple] = []
        for given in batches:
            for at in range(0, given.num_rows, 64):
                part = given.slice(at, 64)
                for row in zip(*[c.to_pylist() for c in part.columns]):
                    for made in make(*row):
                        rows.append(made)
                        if len(rows) >= 4096:
                            yield batch(rows)
                            rows = []
                if rows and sum(len(x) for r in rows for x in r if isinstance(x, (str, bytes))) > 1 << 22:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    return df.mapInArrow(run, out)


def map_batches(df: DataFrame, schema: str, start: Callable[[], Callable[..., tuple]], rows: int = 64) -> DataFrame:
    """Columns made by ``start()(*columns)`` from lists of at most ``rows`` rows of the input's columns."""
    out = StructType.fromDDL(schema)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, make = to_arrow_schema(out), start()
        for given in batches:
            for at in range(0, given.num_rows, rows):
                made = make(*[c.to_pylist() for c in given.slice(at, rows).columns])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(made, arrow)], schema=arrow)

    return df.mapInArrow(run, out)


def map_arrow(df: DataFrame, schema: str, start: Callable[[], Callable]) -> DataFrame:
    """Columns (as `nested` takes them) that ``start()(batch)`` yields for Arrow batches; ``start`` runs once a task."""
    out = StructType.fromDDL(schema)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, make = to_arrow_schema(out), start()
        for given in batches:
            for made in make(given):
                yield pa.RecordBatch.from_arrays([nested(c, f.type) for c, f in zip(made, arrow)], schema=arrow)
    return df.mapInArrow(run, out)


def nested(column, kind):
    """An Arrow array of ``kind`` from the tuple (bounds of the lists, their elements), the elements perhaps such a tuple."""
    import pyarrow as pa

    if not isinstance(column, tuple):
        return pa.array(column, type=kind)
    return pa.ListArray.from_arrays(pa.array(column[0], pa.int32()), nested(column[1], kind.value_type), type=kind)


def map_stream(df: DataFrame, schema: str, rows_of: Callable[[Iterable], Iterable[tuple]]) -> DataFrame:
    """Rows that ``rows_of(batches)`` makes of a partition's Arrow batches, sent on a few at a time."""
    out = StructType.fromDDL(schema)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)], schema=arrow)

        rows: list[tuple] = []
        size = 0
        for row in rows_of(batches):
            rows.append(row)
            size += 64 + sum(len(x) for x in row if isinstance(x, (str, bytes)))
            if size > 1 << 22:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    return df.mapInArrow(run, out)


def plain_rows(batches) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, few at a time in Python."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            yield from zip(*[c.to_pylist() for c in batch.slice(at, 64).columns])


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: smaller than a checkpoint of the same rows."""
    folder = new_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
