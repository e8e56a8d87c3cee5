"""Numbered commits in a shared folder: one file per commit, never replaced.

A commit file appears whole or not at all, and only one of several writers
can create a given number, so ``CommitLog.append(n, ...)`` is a
compare-and-set: it succeeds only for the writer that was first to follow
commit ``n - 1``.  Files are created under a temporary name and then given
their number by a step that fails if it is taken: a hard link where the
folder is a mounted file system, a rename without overwriting elsewhere (a
single step on HDFS).  A store whose rename is not a single step (some object
stores) needs a file system layer that offers one.

Everything here handles file names and a few hundred bytes of JSON a commit;
data never passes through.
"""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def join(root: str, *parts: str) -> str:
    return "/".join([root.rstrip("/")] + [p.strip("/") for p in parts])


def file_system(spark: SparkSession, path: str):
    """``(path, its file system)`` as Hadoop objects."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders directly in ``folder``; none if it isn't there."""
    path, fs = file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def remove(spark: SparkSession, path: str) -> None:
    path, fs = file_system(spark, path)
    fs.delete(path, True)


def move_files(spark: SparkSession, source: str, target: str) -> None:
    """Move the data files of ``source`` into ``target``; a file is there whole or not at all."""
    path, fs = file_system(spark, source)
    to, _ = file_system(spark, target)
    fs.mkdirs(to)
    for s in fs.listStatus(path):
        name = s.getPath().getName()
        if not name.startswith(("_", ".")) and not fs.rename(s.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to, name)):
            raise OSError(f"cannot move {s.getPath()} to {target}")


def modified_ms(spark: SparkSession, path: str) -> int:
    path, fs = file_system(spark, path)
    return fs.getFileStatus(path).getModificationTime()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file with this content unless it is there; whether this call did."""
    jvm = spark.sparkContext._jvm
    target, fs = file_system(spark, path)
    fs.mkdirs(target.getParent())
    temp = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}.tmp")
    out = fs.create(temp, False)
    out.write(text.encode())
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(temp.toUri().getPath(), target.toUri().getPath())
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(fs.makeQualified(temp), fs.makeQualified(target), options)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if not e.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
            raise
        return False
    finally:
        fs.delete(temp, False)


class CommitLog:
    """The commits ``0, 1, 2, ...`` of ``folder``, each a JSON object."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, number: int) -> str:
        return join(self.folder, f"{number:012d}.json")

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in names(self.spark, self.folder) if n.endswith(".json") and n[:-5].isdigit()]

    def read(self, number: int) -> dict:
        path, fs = file_system(self.spark, self._path(number))
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """The highest commit and its content, ``(-1, {})`` before the first."""
        found = self.numbers()
        return (found[-1], self.read(found[-1])) if found else (-1, {})

    def append(self, number: int, content: dict) -> bool:
        """Make commit ``number``; whether this call was the first to."""
        return put_if_absent(self.spark, self._path(number), json.dumps(content))
