"""What the operators share: shipping code, staging, passing rows through Arrow, and joins on skewed keys."""

from __future__ import annotations

import os
import tempfile
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import storage
from ..storage import new_path, shared_dir, stage  # noqa: F401
from . import bloom

#: Rows and bytes that a task turns into Python values at a time. Spark itself bounds the bytes of a batch.
SLICE_ROWS = 512
SLICE_BYTES = 8 << 20
#: Keys that ``join_skewed`` broadcasts.
MOST_HOT = 100_000
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(), "pathloom.zip")  # Spark copies it to the executors
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("pathloom", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most SLICE_ROWS rows, and of about SLICE_BYTES bytes where rows allow it."""
    rows = max(1, min(SLICE_ROWS, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def others(df: DataFrame, taken: list[str]) -> DataFrame:
    """``df`` without the columns that clash with the new names ``taken``."""
    low = {name.lower() for name in taken}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by their places, so that no name can clash; ``renamed`` gives the names back."""
    return df.toDF(*[f"c{i}_" for i in range(len(df.columns))])


def renamed(df: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    return df.select(*[F.col(f"c{i}_").alias(c) for i, c in enumerate(columns)], *more)


def extend(df: DataFrame, fields: list[tuple[str, T.DataType]], inputs: list[str], task: Callable[[], Callable[..., list]]) -> DataFrame:
    """Adds columns computed from Arrow batches.

    ``task`` is called once for each task and gives a function from lists of Python values of ``inputs`` to
    a list for each new field. Columns of ``df`` whose names clash with a new field are replaced, also where they are inputs.
    """
    ship(df.sparkSession)
    names = [n for n, _ in fields]
    base = others(df, names)
    kept = len(base.columns)
    schema = T.StructType([*base.schema.fields, *[T.StructField(n, t) for n, t in fields]])
    kinds = [_arrow(t) for _, t in fields]
    own = [F.col(f"`{c}`") for c in base.columns]
    source = df.select(*own, *[F.col(f"`{c}`").alias(f"__input{i}") for i, c in enumerate(inputs)])

    def run(batches):
        call = task()
        for batch in batches:
            for some in slices(batch):
                new = call(*[c.to_pylist() for c in some.columns[kept:]])
                values = [pa.array(x, k) for x, k in zip(new, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns[:kept], *values], names=schema.names)

    return source.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def frame(columns: dict[str, tuple]) -> pa.RecordBatch:
    """A batch from name -> (values, arrow type)."""
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns.values()], names=list(columns))


def join_skewed(rows: DataFrame, lookup: DataFrame, key: str, weight: str, most: int | None = None, sparse: bool = False) -> DataFrame:
    """``rows`` left-joined with ``lookup``, which has a key once and in ``weight`` the number of rows that have it.

    The ``most`` heaviest keys are broadcast, so no task gets all rows of a hot key. Only if there are more
    keys do rows of the others meet theirs over a shuffle, and a key then has at most 1 / most of all rows. Rows with a null
    key stay out of that shuffle, and with ``sparse`` those that a Bloom filter of the keys rejects. ``rows``
    is read several times in that case, and should be staged or cheap.
    """
    most = MOST_HOT if most is None else most
    lookup = stage(lookup, "lookup")
    count = lookup.count()
    if count <= most:
        return rows.join(F.broadcast(lookup.drop(weight)), key, "left")
    heavy = stage(lookup.orderBy(F.desc(weight), key).limit(most), "heavy").drop(weight)
    first = rows.join(F.broadcast(heavy), key)
    light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    asked = F.col(key).isNotNull()
    if sparse:
        asked &= bloom.tester(lookup, F.col(key), count)(F.col(key))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in lookup.schema.fields if f.name not in (key, weight)]
    joined = light.filter(asked).join(lookup.drop(weight), key, "left")
    return first.unionByName(joined).unionByName(light.filter(~asked).select("*", *none))


def share(column, salt: str):
    """A number from 0 to 1 that a row's key decides: below f for a share f of keys."""
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(1_000_003)) / 1_000_003.0


def crc_mod(column, n: int):
    """crc32 of a column's text, modulo n; null where the column is null."""
    return F.crc32(F.encode(column.cast("string"), "UTF-8")) % n


def unsigned_crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def row_key():
    """A number for each row of a scan of written files. It is the same if a lost task runs again."""
    return F.monotonically_increasing_id()


def drop(*staged: DataFrame) -> None:
    for df in staged:
        storage.drop(df)
