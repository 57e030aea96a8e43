"""Data sets by name, from a folder of Parquet files, as a data source of their own.

    register(spark)
    spark.read.format("named").option("name", "diabetes").load(folder)

A set is one or more files whose names begin with its own; every row group is a partition, and of a file only the columns of the schema that
is asked for are read: all of the set's, unless ``columns`` or a schema names some. Executors must see the folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from glob import escape, glob
from os.path import join

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, StructField, StructType

#: The features of each set, and its target.
SETS = {
    "diabetes": ("age sex bmi bp s1 s2 s3 s4 s5 s6", "progression"),
    "housing": ("MedInc HouseAge AveRooms AveBedrms Population AveOccup Latitude Longitude", "MedHouseVal"),
}


def features(name: str) -> list[str]:
    return SETS[name][0].split()


def target(name: str) -> str:
    return SETS[name][1]


class RowGroup(InputPartition):
    def __init__(self, file: str, group: int):
        self.file, self.group = file, group


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, folder: str, name: str):
        self.wanted, self.folder, self.set = schema, folder, name

    def partitions(self) -> list[RowGroup]:
        files = sorted(glob(join(escape(self.folder), f"{self.set}*.parquet")))
        if not files:
            raise FileNotFoundError(f"no file of the set {self.set!r} in {self.folder}")
        return [RowGroup(f, g) for f in files for g in range(pq.ParquetFile(f).metadata.num_row_groups)]

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(f.name, pa.float64()) for f in self.wanted.fields])
        with pq.ParquetFile(partition.file) as file:
            for batch in file.iter_batches(row_groups=[partition.group], columns=self.wanted.names):
                yield from pa.Table.from_batches([batch]).select(self.wanted.names).cast(kinds).to_batches()


class NamedSets(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named"

    def _set(self) -> str:
        name = self.options.get("name", "")
        if name not in SETS:
            raise ValueError(f"no set {name!r}; there are {', '.join(SETS)}")
        return name

    def schema(self) -> StructType:
        name = self._set()
        every = [*features(name), target(name)]
        asked = [c.strip() for c in self.options["columns"].split(",")] if "columns" in self.options else every
        if unknown := set(asked) - set(every):
            raise ValueError(f"{name} has no column {', '.join(sorted(unknown))}")
        return StructType([StructField(c, DoubleType()) for c in asked])

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options["path"], self._set())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NamedSets)
