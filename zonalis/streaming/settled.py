"""A stream over files that have settled: format ``settledfiles``.

A writer may still be at work on a young file. This source admits a file once it has not changed for ``age`` seconds; until then it
stays out of every batch and waits for a later one. Offsets count batches. Which files a batch holds is written to the folder
``log`` before the batch runs, so a replay reads the same files, and a file is admitted once, whatever its age or name. (Spark's own
file source reads a file the moment it is listed.)

Options: path, log, age (seconds, 120), files (most per batch, all). Path and log are paths or URIs that Arrow's file systems
open and all hosts see. The trigger ``availableNow`` runs one batch. A partition is a Parquet file, read row group by row group. Columns come by name; missing ones are NULL.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from zonalis.session import ship_package
from zonalis.sources.tile_files import opened

FORMAT = "settledfiles"


class FilePartition(ds.InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class SettledReader(ds.DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.log = options["path"], options["log"]
        self.age, self.most = float(options.get("age", 120)), int(options.get("files", 0))
        self.schema = schema

    def _entries(self) -> list[int]:
        fs, log = opened(self.log)
        found = fs.get_file_info(afs.FileSelector(log, allow_not_found=True))
        return sorted(int(i.base_name) for i in found if i.base_name.isdigit())

    def _admitted(self, entry: int) -> list[str]:
        fs, log = opened(self.log)
        with fs.open_input_stream(f"{log}/{entry}") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        """Admit what has settled since, if anything has."""
        entries = self._entries()
        known = {p for e in entries for p in self._admitted(e)}
        fs, root = opened(self.path)
        now = time.time()
        ready = [(i.mtime_ns, i.path) for i in fs.get_file_info(afs.FileSelector(root, recursive=True, allow_not_found=True))
                 if i.type == afs.FileType.File and i.base_name.endswith(".parquet") and i.base_name[0] not in "._"
                 and i.path not in known and now - i.mtime_ns / 1e9 >= self.age]
        new = [p for _, p in sorted(ready)][:self.most or None]
        last = entries[-1] if entries else 0
        if new:
            last += 1
            out, log = opened(self.log)
            out.create_dir(log, recursive=True)
            with out.open_output_stream(f"{log}/.{last}") as f:
                f.write(json.dumps(new).encode())
            out.move(f"{log}/.{last}", f"{log}/{last}")
        return {"batch": last}

    def partitions(self, start: dict, end: dict) -> Sequence[FilePartition]:
        return [FilePartition(p) for e in self._entries() if start["batch"] < e <= end["batch"] for p in self._admitted(e)]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        wanted = to_arrow_schema(self.schema)
        with fs.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=[n for n in wanted.names if n in pq.read_schema(f).names]):
                cols = [batch.column(batch.schema.get_field_index(x.name)).cast(x.type) if x.name in batch.schema.names else pa.nulls(batch.num_rows, x.type)
                        for x in wanted]
                yield pa.RecordBatch.from_arrays(cols, names=wanted.names)


class SettledFiles(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamReader(self, schema: StructType) -> SettledReader:
        return SettledReader(self.options, schema)


def settled_stream(spark: SparkSession, path: str, log: str, schema: StructType, age: float = 120, files_per_batch: int = 0) -> DataFrame:
    ship_package(spark)
    spark.dataSource.register(SettledFiles)
    return spark.readStream.format(FORMAT).schema(schema).options(path=path, log=log, age=age, files=files_per_batch).load()
