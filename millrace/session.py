"""Session settings and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def session(app: str = "millrace", master: str | None = None, input_gb: float | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; shuffle partitions of about 128 MB if the input's size is given."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if input_gb:
        b = b.config("spark.sql.shuffle.partitions", str(max(8, round(input_gb * 8))))
    return b.config(map=SETTINGS | settings).getOrCreate()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; a temporary folder only where that is unset on one machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Schemes of stores whose rename is one step and refuses an existing target. Object stores copy instead.
ATOMIC = {"file", "hdfs", "viewfs", "abfs", "abfss", "ofs"}


def listing(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime) of files by a glob on their names; their content is not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(root)
    return found.select("path", "length", "modificationTime")


class Files:
    """The file operations that manifests need, on whatever store Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def sizes(self, folder: str) -> dict[str, int]:
        at = self._path(folder)
        return {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(at)} if self._fs.exists(at) else {}

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not exist yet; False if another writer was first."""
        side = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._path(side), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._fs.exists(self._path(name)) and self._fs.rename(self._path(side), self._path(name)):
            return True
        self._fs.delete(self._path(side), False)
        return False

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def renames_atomically(self) -> bool:
        return self._fs.getScheme() in ATOMIC

    def read_range(self, name: str, offset: int = 0, limit: int | None = None) -> bytes:
        """Bytes from ``offset``, at most ``limit`` of them."""
        stream = self._fs.open(self._path(name))
        try:
            stream.seek(offset)
            return bytes(stream.readAllBytes() if limit is None else stream.readNBytes(limit))
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write a file, over an old one if there is one."""
        stream = self._fs.create(self._path(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def append(self, name: str, text: str) -> None:
        """Add to a file's end; a store that cannot append gets the file anew."""
        old = self.read(name) if self._fs.exists(self._path(name)) else ""
        self.write(name, old + text)

    def copy(self, source: str, target: str) -> None:
        """A file or a folder with all below it."""
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, self._path(source), self._fs, self._path(target), False, self._conf)

    def copy_to(self, source: str, other: Files, target: str) -> None:
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, self._path(source), other._fs, other._path(target), False, self._conf)

    def move(self, source: str, target: str) -> bool:
        return self._fs.rename(self._path(source), self._path(target))
