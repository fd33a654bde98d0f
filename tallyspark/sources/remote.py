"""A reader of its own for relations of the remote root, as a Spark data
source (``tallyspark_remote``).

A scan names its columns and the filters it sends along; the reader opens only
these columns, plans one task for each file of the partitions that the filters
leave over, and keeps the other rows on the remote side.  A fixed-size filter
of join keys, made from a local relation, can go along too.

The filters are those of the scan, not Spark's own push-down (``pushFilters``):
Spark 4.1 keeps one pushed state for each load, so a relation that a plan reads
twice with two filters would get the rows of the later filter both times.
Filters that a report adds to the scan are evaluated by Spark as usual.

Files are opened with pyarrow (local or mounted paths, or any URI that its
file systems know).
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from tallyspark.sources.manifest import NO_VALUE, Manifest

FORMAT = "tallyspark_remote"
#: Size of a key filter: 2^16 bits, whatever the number of keys.
FILTER_BITS, FILTER_HASHES = 1 << 16, 4


# ------------------------------------------------------------- key filter
def key_filter(keys: DataFrame, column: str) -> str:
    """The keys' bit filter, as text: set bits are found by Spark, of which
    there are at most ``FILTER_BITS`` however many keys there are.  A full
    filter lets every row pass."""
    places = F.array(*(F.pmod(F.crc32(F.concat(F.lit(f"{i}:"), F.col(column))), F.lit(FILTER_BITS))
                       for i in range(FILTER_HASHES)))
    found = keys.where(F.col(column).isNotNull()).select(F.explode(places).alias("bit")).distinct().toPandas()["bit"]
    bits = np.zeros(FILTER_BITS, dtype=bool)
    bits[found.to_numpy(dtype=np.int64)] = True
    return base64.b64encode(np.packbits(bits).tobytes()).decode()


def may_hold(bits: np.ndarray, key: str | None) -> bool:
    """Whether a key may be among those of the filter; NULL joins nothing."""
    return key is not None and all(bits[zlib.crc32(f"{i}:{key}".encode()) % FILTER_BITS] for i in range(FILTER_HASHES))


def _keep_keys(batch: pa.RecordBatch, column: str, bits: np.ndarray) -> pa.RecordBatch:
    coded = batch.column(column).dictionary_encode()
    wanted = pa.array([may_hold(bits, k) for k in coded.dictionary.to_pylist()], pa.bool_())
    return batch.filter(pc.fill_null(wanted.take(coded.indices), False))


# ----------------------------------------------------------------- reader
COMPARE = {"=": lambda f, v: f == v[0], "<>": lambda f, v: f != v[0], "<": lambda f, v: f < v[0],
           "<=": lambda f, v: f <= v[0], ">": lambda f, v: f > v[0], ">=": lambda f, v: f >= v[0],
           "in": lambda f, v: f.isin(v)}


def _expression(column: str, op: str, values: list[str], kind: pa.DataType):
    """One filter for pyarrow.  A NULL passes none, as in SQL."""
    field = ds.field(column)
    return field.is_valid() & COMPARE[op](field, [pa.scalar(v).cast(kind) for v in values])


@dataclass
class Files(InputPartition):
    """One file and the value of its partition column."""

    path: str
    part: str | None


class RemoteReader(DataSourceReader):
    """``folders``: (path, partition value or None) as the manifest lists them;
    ``where``: (column, operator, values as text); ``keys``: column and filter."""

    def __init__(self, schema: T.StructType, folders: list, part: str | None, where: list = (),
                 keys: tuple[str, str] | None = None):
        self.schema, self.folders, self.part_column = schema, folders, part
        self.where, self.keys = list(where), keys

    def _kind(self, column: str) -> pa.DataType:
        return to_arrow_schema(self.schema).field(column).type

    def _filters(self, of_part: bool) -> list:
        return [_expression(c, op, v, self._kind(c)) for c, op, v in self.where if (c == self.part_column) is of_part]

    def _part_values(self, text: str | None, n: int) -> pa.Array:
        kind = self._kind(self.part_column)
        return pa.array([pa.scalar(None if text == NO_VALUE else text, pa.string()).cast(kind).as_py()] * n, kind)

    def _wanted(self, text: str | None) -> bool:
        """Whether the filters on the partition column leave the folder over."""
        if self.part_column not in self.schema.names:
            return True
        row = pa.table({self.part_column: self._part_values(text, 1)})
        return all(row.filter(e).num_rows for e in self._filters(of_part=True))

    def partitions(self) -> list[Files]:
        files = [Files(file, part) for folder, part in self.folders if self.part_column is None or self._wanted(part)
                 for file in ds.dataset(folder, format="parquet").files]
        # Spark wants a task even where no file is left over.
        return files or [Files("", None)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        target = to_arrow_schema(self.schema)
        stored = [n for n in self.schema.names if n != self.part_column]
        narrow = None
        for e in self._filters(of_part=False):
            narrow = e if narrow is None else narrow & e
        bits = None if self.keys is None else np.unpackbits(
            np.frombuffer(base64.b64decode(self.keys[1]), np.uint8)).astype(bool)
        for batch in ds.dataset(partition.path, format="parquet").to_batches(columns=stored, filter=narrow):
            if bits is not None:
                batch = _keep_keys(batch, self.keys[0], bits)
            if not batch.num_rows:
                continue
            columns = []
            for field in target:
                if field.name == self.part_column:
                    columns.append(self._part_values(partition.part, batch.num_rows))
                else:
                    columns.append(batch.column(field.name).cast(field.type))
            yield pa.RecordBatch.from_arrays(columns, schema=target)


class RemoteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema: T.StructType) -> DataSourceReader:
        o = self.options
        keys = (o["keys"], o["key_filter"]) if "key_filter" in o else None
        return RemoteReader(schema, json.loads(o["folders"]), o.get("part"), json.loads(o["where"]), keys)


class RemoteCatalog:
    """The relations of a stored catalog, read by the reader above."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifest = Manifest.latest(spark, self.root)
        spark.dataSource.register(RemoteSource)

    def scan(self, name: str, columns: Iterable[str], where: Iterable[tuple] = (),
             keys: tuple[str, DataFrame] | None = None) -> DataFrame:
        """These columns of a relation, of the rows that pass every filter of
        ``where``: (column, one of ``= <> < <= > >= in``, value or list), on
        columns that are read.  ``keys`` (column, local relation with it) also
        leaves rows out whose key is certainly not in that relation; some
        others may come along, so the join itself stays."""
        entry, columns = self.manifest.relations[name], list(columns)
        filters = [(c, op, [str(v) for v in (value if op == "in" else [value]) if v is not None])
                   for c, op, value in where]
        unread = {c for c, _, _ in filters} | ({keys[0]} if keys else set())
        if unread - set(columns):
            raise ValueError(f"filters on columns that are not read: {sorted(unread - set(columns))}")
        for c, op, values in filters:
            if op not in COMPARE or (op != "in" and not values):
                raise ValueError(f"no such filter: {c} {op} {values}")
        stored = T.StructType.fromJson(json.loads(entry["schema"]))
        schema = T.StructType([T.StructField(c, stored[c].dataType) for c in columns])
        folders = [(f"{self.root}/{name}/commit={c}" + (f"/{entry['part']}={d}" if d else ""), d or None)
                   for d, commits in sorted(entry["folders"].items()) for c in commits]
        reader = (self.spark.read.format(FORMAT).schema(schema).option("folders", json.dumps(folders))
                  .option("where", json.dumps(filters)))
        if entry["part"]:
            reader = reader.option("part", entry["part"])
        if keys is not None:
            reader = reader.option("keys", keys[0]).option("key_filter", key_filter(keys[1], keys[0]))
        return reader.load()
