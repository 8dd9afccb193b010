"""The few file operations that tables and versions need beside reading and writing rows.

On a mounted folder they are plain system calls; on any other store they go through the engine's own file system. This
module is the only one that reaches for that.
"""

from __future__ import annotations

import os
import shutil
import uuid
from urllib.parse import unquote, urlsplit

from pyspark.sql import SparkSession


class Store:
    """Names, small texts and removal below one root folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root = root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        mounted = str(self._fs.getUri()).startswith("file:")
        self._local = unquote(urlsplit(self.root).path) if "://" in self.root or self.root.startswith("file:") else self.root if mounted else None
        self._local = os.path.abspath(self._local) if mounted else None

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        """Names in a folder; none if it does not exist."""
        if self._local is not None:
            at = os.path.join(self._local, folder)
            return sorted(n for n in os.listdir(at) if not n.startswith(".")) if os.path.isdir(at) else []
        if not self._fs.exists(self._path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def read(self, name: str) -> str:
        if self._local is not None:
            with open(os.path.join(self._local, name), encoding="utf-8") as file:
                return file.read()
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Put a text under a name that nobody has; False if somebody has it. Readers see the whole text or nothing.

        The text is written aside and then gets its name: by a link on a mounted folder, else by a rename, which HDFS
        refuses for a name that exists.
        """
        aside = f"{os.path.dirname(name)}/.{uuid.uuid4().hex}".lstrip("/")
        if self._local is not None:
            temporary, final = os.path.join(self._local, aside), os.path.join(self._local, name)
            os.makedirs(os.path.dirname(final), exist_ok=True)
            with open(temporary, "w", encoding="utf-8") as file:
                file.write(text)
                file.flush()
                os.fsync(file.fileno())
            try:
                os.link(temporary, final)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(temporary)
        stream = self._fs.create(self._path(aside), False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        if not self._fs.exists(self._path(name)) and self._fs.rename(self._path(aside), self._path(name)):
            return True
        self._fs.delete(self._path(aside), False)
        return False

    def remove(self, name: str) -> None:
        """Remove a file or folder of this store; one that is gone already is no error."""
        if not name or name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"not below the store: {name!r}")
        if self._local is None:
            self._fs.delete(self._path(name), True)
            return
        at = os.path.join(self._local, name)
        if os.path.isdir(at):
            shutil.rmtree(at, ignore_errors=True)
        elif os.path.exists(at):
            os.unlink(at)
