"""Replacing a written folder so that its old rows are never lost (K1, K3).

The new folder is written beside the old one. The old one is then set aside under a name of its own, the new one takes its
place, and only then the old one is removed. A job that ends between these steps leaves the old rows where ``standing_path``
finds them; the next write puts them back first. One writer at a time is assumed; readers may come at any time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

NEW, OLD = ".new-", ".old-"


class Folders:
    """The few steps on folders that are needed, by Spark's own file access."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._files.exists(self._path(path))

    def move(self, source: str, target: str) -> None:
        if not self._files.rename(self._path(source), self._path(target)):
            raise OSError(f"{source} could not be moved to {target}")

    def remove(self, path: str) -> None:
        self._files.delete(self._path(path), True)

    def beside(self, path: str, mark: str) -> list[str]:
        """Folders that belong to ``path`` by their names, oldest first."""
        target = self._path(path)
        if target.getParent() is None or not self._files.exists(target.getParent()):
            return []
        start = target.getName() + mark
        found = [f for f in self._files.listStatus(target.getParent()) if f.getPath().getName().startswith(start)]
        return [f"{path}{f.getPath().getName()[len(target.getName()):]}" for f in sorted(found, key=lambda f: f.getModificationTime())]


def standing_path(spark: SparkSession, path: str) -> str:
    """Where the rows of ``path`` are: there, or, after a replacement that did not end, in the folder set aside.

    A pattern, or a path without anything, is given back as it is.
    """
    path = path.rstrip("/")
    if any(c in path for c in "*?[{"):
        return path
    folders = Folders(spark, path)
    if folders.exists(path):
        return path
    aside = folders.beside(path, OLD)
    return aside[-1] if aside else path


def settle(spark: SparkSession, path: str) -> None:
    """Puts back what a replacement that did not end has set aside, and removes what it left over."""
    folders, path = Folders(spark, path), path.rstrip("/")
    standing = standing_path(spark, path)
    if standing != path:
        folders.move(standing, path)
    for left in folders.beside(path, NEW) + folders.beside(path, OLD):
        folders.remove(left)


def replace_folder(spark: SparkSession, path: str, write: Callable[[str], bool]) -> bool:
    """Replaces ``path`` by what ``write`` writes to the folder it is given, if ``write`` says so; returns its answer."""
    path = path.rstrip("/")
    settle(spark, path)
    folders, mark = Folders(spark, path), uuid.uuid4().hex
    new, old = f"{path}{NEW}{mark}", f"{path}{OLD}{mark}"
    try:
        wanted = write(new)
        if wanted and folders.exists(path):
            folders.move(path, old)
        if wanted:
            folders.move(new, path)
    except Exception:
        # What can be undone is undone at once; a crash leaves it to the next write.
        if folders.exists(old) and not folders.exists(path):
            folders.move(old, path)
        folders.remove(new)
        raise
    folders.remove(old if wanted else new)
    return wanted
