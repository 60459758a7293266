"""The few calls on a shared file system that trees, logs and catalogues need; metadata only, never rows."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """The file system that a root lies on, as Spark sees it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._paths = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils

    def path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def names(self, folder: str) -> list[str]:
        """Names in a folder; none if there is no such folder."""
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(folder))] if self.exists(folder) else []

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def text(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, path: str, text: str) -> None:
        """A whole file that appears at once; an error if it exists."""
        folder, _, name = path.rpartition("/")
        draft = f"{folder}/.{name}"
        out = self.fs.create(self.path(draft), True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(self.path(draft), self.path(path)):
            raise FileExistsError(f"{path} exists: two writers?")

    def partition(self, column: str, value) -> str:
        """The folder name of a partition value, as Spark writes it."""
        return self._paths.getPartitionPathString(column, None if value is None else str(value))

    def partitions(self, root: str, columns: list[str]) -> list[tuple[str, ...]]:
        """The partition values of the folders below a root, as text."""
        found: list[tuple[str, tuple[str, ...]]] = [(root.rstrip("/"), ())]
        for c in columns:
            found = [(f"{folder}/{name}", (*values, self._paths.unescapePathName(name.partition("=")[2])))
                     for folder, values in found for name in self.names(folder) if name.startswith(f"{c}=")]
        return [values for _, values in found]
