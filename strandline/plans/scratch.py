"""Folders for tables that a query writes and reads again, and small JSON files that name what is in them."""

from __future__ import annotations

import atexit
import hashlib
import json
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, what: str) -> str:
    """A new folder below the one that driver and executors share; local mode has one of its own, which goes at the end."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="strandline-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Store:
    """Files below a folder of any of Spark's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(self._conf)

    def at(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(self.at(name) if name else self.folder), True)

    def copy(self, name: str, target: str) -> None:
        """Copies a file to a full address."""
        to = self._path(target)
        self._fs.mkdirs(to.getParent())
        self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, self._path(self.at(name)), to.getFileSystem(self._conf), to, False, self._conf)

    def files(self, name: str) -> list[tuple[str, int]]:
        """Data files directly in a folder, by name, with their lengths; nothing if it isn't there."""
        where = self.at(name) if name else self.folder
        if not self._fs.exists(self._path(where)):
            return []
        found = [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(self._path(where)) if s.isFile()]
        return sorted(x for x in found if not x[0].startswith(("_", ".")))

    def entries(self) -> list[str]:
        """Files and folders directly below, by name."""
        if not self._fs.exists(self._path(self.folder)):
            raise FileNotFoundError(self.folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(n for n in names if not n.startswith(("_", ".")))

    def digest(self, name: str) -> str:
        """A digest of the names and lengths of a folder's files: writers name each file anew, so a lost, added or cut one shows."""
        return hashlib.sha256(repr(self.files(name)).encode()).hexdigest()

    def load(self, name: str):
        """The content of a JSON file, None if there is none."""
        if not self.exists(name):
            return None
        return json.loads("\n".join(r[0] for r in self.spark.read.text(self.at(name)).collect()))

    def put(self, name: str, text: str) -> None:
        """Writes a text file, in place of what it was."""
        out = self._fs.create(self._path(self.at(name)), True)
        out.write(text.encode())
        out.close()

    def create(self, name: str, content) -> None:
        """Writes a JSON file that must not exist yet."""
        out = self._fs.create(self._path(self.at(name)), False)
        out.write(json.dumps(content, indent=1).encode())
        out.close()

    def save(self, name: str, content) -> None:
        """Writes a JSON file beside the old one and takes its place in one step."""
        new = f"{name}.{uuid.uuid4().hex[:8]}"
        self.create(new, content)
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        rename = getattr(hadoop, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        source, target = (self._fs.makeQualified(self._path(self.at(n))) for n in (new, name))
        hadoop.FileContext.getFileContext(target.toUri(), self._conf).rename(source, target, how)
