"""Publishing: new rows take the place of old ones only when all of them are written.

Two ways. A folder that any Parquet reader reads (store) is written beside its place and then takes it by renames; what a
killed job leaves between two renames is put right by recover(), which every store and load does first. A published folder
holds whole versions and a pointer, a small file that one rename replaces: its readers see the old rows or the new ones at
every moment, and those that began with the old version go on reading it.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

POINTER = "_CURRENT"
#: A folder that a killed job left half written is deleted when it is this old.
STALE_HOURS = 24


class Folder:
    """A folder of the file system that its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self.fs = self.at().getFileSystem(self._conf)

    def at(self, name: str = "") -> JavaObject:
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    @property
    def name(self) -> str:
        return self.path.rpartition("/")[2]

    def beside(self, name: str) -> Folder:
        return Folder(self.spark, f"{self.path.rpartition('/')[0]}/{name}")

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.at(name))

    def folders(self) -> dict[str, int]:
        """Names of the folders inside, with the times of their last change in milliseconds."""
        if not self.exists():
            return {}
        return {f.getPath().getName(): f.getModificationTime() for f in self.fs.listStatus(self.at()) if f.isDirectory()}

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.at(name), True)

    def move_to(self, other: Folder) -> None:
        if not self.fs.rename(self.at(), other.at()):
            raise OSError(f"{self.path} can't be renamed to {other.path}")

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """A small file with this text, in place of the old one by one rename."""
        new = f"{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.at(new), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        jvm = self.spark.sparkContext._gateway
        overwrite = jvm.new_array(self._hadoop.Options.Rename, 1)
        overwrite[0] = self._hadoop.Options.Rename.OVERWRITE
        self._hadoop.FileContext.getFileContext(self.at().toUri(), self._conf).rename(self.at(new), self.at(name), overwrite)


def _left_over(folder: Folder) -> tuple[list[Folder], list[Folder]]:
    """What stores of this folder have left beside it: new rows, and old ones on their way out; the latest first."""
    beside = Folder(folder.spark, folder.path.rpartition("/")[0])
    found = sorted(beside.folders().items(), key=lambda f: (-f[1], f[0]))
    return tuple([folder.beside(n) for n, _ in found if n.startswith(f".{folder.name}.{kind}-")] for kind in ("new", "old"))


def recover(spark: SparkSession, path: str) -> None:
    """Ends a store that was killed between its renames, and deletes what killed stores have left for more than a day.

    Old rows move away only when the new ones are complete: where the folder is missing, the complete new rows take its place,
    else the old ones come back.
    """
    folder = Folder(spark, path)
    new, old = _left_over(folder)
    if not folder.exists() and old:
        complete = [f for f in new if f.exists("_SUCCESS")]
        (complete or old)[0].move_to(folder)
        new, old = _left_over(folder)
    if folder.exists():
        for f in old:
            f.delete()
    times = Folder(spark, folder.path.rpartition("/")[0]).folders()
    for f in new:
        if times.get(f.name, 0) < (time.time() - 3600 * STALE_HOURS) * 1000:
            f.delete()


def replace_folder(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Df as Parquet files in place of what is at path, which df may read.

    A job that fails or is killed while it writes leaves the old rows. Between two renames the folder is missing for a moment; for
    readers that may not see that, use publish().
    """
    spark = df.sparkSession
    recover(spark, path)
    folder = Folder(spark, path)
    tag = uuid.uuid4().hex
    new, old = folder.beside(f".{folder.name}.new-{tag}"), folder.beside(f".{folder.name}.old-{tag}")
    try:
        df.write.partitionBy(*(partition_by or [])).parquet(new.path)
    except BaseException:
        new.delete()
        raise
    if folder.exists():
        folder.move_to(old)
    new.move_to(folder)
    old.delete()


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the version that counts; None before the first."""
    folder = Folder(spark, path)
    return f"{folder.path}/{folder.read(POINTER)}" if folder.exists(POINTER) else None


def new_version(folder: Folder) -> str:
    """A name after those of all versions that are there."""
    numbers = [int(v[1:].partition("-")[0]) for v in folder.folders() if v.startswith("v")]
    return f"v{max(numbers, default=0) + 1:09d}-{uuid.uuid4().hex}"


def prune(folder: Folder, now: str, keep: int) -> None:
    """Deletes the versions before the one that counts but the last keep - 1; later ones may still be written by others."""
    before = sorted(v for v in folder.folders() if v.startswith("v") and v < now)
    for v in before[: max(0, len(before) - keep + 1)]:
        folder.delete(v)


def publish(df: DataFrame, path: str, partition_by: list[str] | None = None, keep: int = 2) -> str:
    """Df as the next version of a published folder, which df may read; the version's folder.

    Readers see the old version until one rename makes the pointer name the new one. The last `keep` versions stay, so that
    who reads the one before comes to an end. Of two jobs that publish at once the one that ends last counts, whole.
    """
    folder = Folder(df.sparkSession, path)
    version = new_version(folder)
    try:
        df.write.partitionBy(*(partition_by or [])).parquet(f"{folder.path}/{version}")
    except BaseException:
        folder.delete(version)
        raise
    folder.replace(POINTER, version)
    prune(folder, version, keep)
    return f"{folder.path}/{version}"


def published(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the version that counts now; a later publish() doesn't change this DataFrame."""
    version = current(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(version)


@contextmanager
def claimed(spark: SparkSession, path: str) -> Iterator[None]:
    """The right to publish the next version: for jobs whose new rows follow from the version that they have read.

    A file that only one job can create names the version that was read; who finds it there, or another version published meanwhile, gets a
    RuntimeError. A killed job's file counts for a day.
    """
    folder, before = Folder(spark, path), current(spark, path)
    name = f"_CLAIM.{(before or '').rpartition('/')[2] or 'first'}"
    if folder.exists(name) and folder.fs.getFileStatus(folder.at(name)).getModificationTime() < (time.time() - 3600 * STALE_HOURS) * 1000:
        folder.delete(name)
    if not folder.fs.createNewFile(folder.at(name)):
        raise RuntimeError(f"another job extends {path}")
    try:
        if current(spark, path) != before:
            raise RuntimeError(f"another job has extended {path}")
        yield
    finally:
        folder.delete(name)
