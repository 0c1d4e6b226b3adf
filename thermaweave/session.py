"""What jobs need of the session: a folder that driver and executors share, and this package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the session names none, as in local tests, a temporary folder is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="thermaweave-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def deliver(spark: SparkSession) -> None:
    """Send this package to the executors, which need not have it on their path."""
    context = spark.sparkContext
    if getattr(context, "_thermaweave_sent", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="thermaweave-")) / "thermaweave.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
    context._thermaweave_sent = True


class Files:
    """A folder in whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark.sparkContext._jvm, path.rstrip("/")
        hadoop = self.jvm.org.apache.hadoop.fs
        self.path = hadoop.Path
        self.system = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.system.exists(self.path(f"{self.root}/{name}"))

    def make(self) -> None:
        self.system.mkdirs(self.path(self.root))

    def delete(self, name: str) -> None:
        self.system.delete(self.path(f"{self.root}/{name}"), True)

    def read(self, name: str) -> str | None:
        """The text of a file of this folder; None if there is none."""
        if not self.exists(name):
            return None
        stream = self.system.open(self.path(f"{self.root}/{name}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The text as a file that is there in whole or not at all."""
        aside = self.path(f"{self.root}/_{name}.new")
        stream = self.system.create(aside, True)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        self.system.delete(self.path(f"{self.root}/{name}"), False)
        if not self.system.rename(aside, self.path(f"{self.root}/{name}")):
            raise OSError(f"could not write {self.root}/{name}")

    def matching(self, pattern: str) -> dict[str, list]:
        """Path -> [bytes, time of change] of all files that match a pattern."""
        found = self.system.globStatus(self.path(pattern)) or []
        return {s.getPath().toString(): [s.getLen(), s.getModificationTime()] for s in found if s.isFile()}

    def states(self, paths) -> dict[str, list]:
        """Path -> [bytes, time of change] of the files given."""
        return {s.getPath().toString(): [s.getLen(), s.getModificationTime()] for s in (self.system.getFileStatus(self.path(p)) for p in paths)}
