"""Folders and small files of any file system Spark can reach, and numbered commits among them.

Names that begin with `_` are not seen by Spark's readers, so what such a folder holds is not part of a table until it is moved. Moving
is what makes commits whole: on HDFS and alike it is atomic and never replaces a file. Object stores copy instead; there a table
needs one writer at a time.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Folder:
    """A folder that may not be there yet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """What lies in the folder itself; one listing."""
        found = self._at(name)
        return sorted(entry.getPath().getName() for entry in self._files.listStatus(found)) if self._files.exists(found) else []

    def exists(self, name: str) -> bool:
        return self._files.exists(self._at(name))

    def delete(self, name: str) -> None:
        self._files.delete(self._at(name), True)

    def move(self, name: str, to: str) -> bool:
        """Moves a file or folder, if nothing is there; says whether it did. Of two that try at once, one does."""
        target = self._at(to)
        self._files.mkdirs(target.getParent())
        gateway = self.spark.sparkContext._gateway
        context = self._hadoop.FileContext.getFileContext(self._files.getUri(), self._conf)
        plain = gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._files.makeQualified(self._at(name)), self._files.makeQualified(target), plain)
        except Exception as problem:
            if "FileAlreadyExistsException" not in str(problem):
                raise
            return False
        return True

    def read_json(self, name: str) -> dict:
        stream = self._files.open(self._at(name))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def write_json(self, name: str, content: dict) -> bool:
        """Writes a file as a whole, if there is none of that name; says whether it did."""
        draft = f"_drafts/{uuid.uuid4().hex}"
        stream = self._files.create(self._at(draft), True)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        if self.move(draft, name):
            return True
        self.delete(draft)
        return False


class CommitLog:
    """States of a table, one numbered file each: the one with the highest number counts.

    A commit states the whole new content of the table, so reading takes one small file. It only succeeds as the next
    of the one it was made from: of two writers one is refused and starts again from what the other has written.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def numbers(self) -> list[int]:
        return sorted(int(name[:-5]) for name in self.folder.names("_commits") if re.fullmatch(r"\d{20}\.json", name))

    def read(self, number: int) -> dict:
        return self.folder.read_json(f"_commits/{number:020d}.json")

    def last(self) -> tuple[int, dict | None]:
        """The number and content of the last commit; 0 and None before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, None)

    def write(self, number: int, content: dict) -> bool:
        return self.folder.write_json(f"_commits/{number:020d}.json", content)

    def change(self, step: Callable[[dict | None], dict | None], tries: int = 100) -> dict | None:
        """Commits what `step` makes of the last content, anew if another writer was first; None commits nothing."""
        for _ in range(tries):
            number, content = self.last()
            made = step(content)
            if made is None:
                return content
            if self.write(number + 1, made):
                return made
        raise RuntimeError(f"{tries} other writers were first at {self.folder.path}")

    def forget(self, keep: int) -> list[dict]:
        """Deletes all commits but the last `keep`; returns the contents of those deleted."""
        gone = [(number, self.read(number)) for number in self.numbers()[:-keep]]
        for number, _ in gone:
            self.folder.delete(f"_commits/{number:020d}.json")
        return [content for _, content in gone]
