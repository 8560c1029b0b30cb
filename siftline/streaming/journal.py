"""Replies of paid calls, kept in shared storage as they come.

Every reply is a file of its own, named by what was asked, and is there whole before the next call is
made.  A task that is tried again, or a run that follows a broken one, finds what was answered
and asks for the rest only.  A run's round has a folder; what it takes over from the folder of a
broken round it moves to its own, and the folder goes when the round's results are committed.

An answer counts wherever it is found.  A failure counts in its own round only: there it is not
tried over by the next attempt of the task, later rounds try it anew.

The folder is opened by ``pyarrow.fs`` (file, hdfs, s3, gs, abfs).  Two attempts of one task that run
at the same time may ask for the same thing; keep ``spark.speculation`` off.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import SparkSession

from siftline.sources import shared


def call_key(model: str, prompt: str) -> str:
    return hashlib.sha256(f"{model}\0{prompt}".encode("utf-8", "surrogatepass")).hexdigest()


@dataclass(frozen=True)
class Journal:
    """``folder``/``round`` holds this round's replies; ``earlier``: rounds that were not committed."""

    folder: str
    round: str
    earlier: tuple[str, ...] = ()

    def _open(self) -> tuple[pafs.FileSystem, str]:
        where = self.folder if "://" in self.folder or self.folder.startswith("file:") else f"file://{self.folder}"
        if where.startswith("file:") and not where.startswith("file://"):
            where = "file://" + where.removeprefix("file:")
        return pafs.FileSystem.from_uri(where)

    def writer(self) -> JournalWriter:
        found, path = self._open()
        return JournalWriter(found, path.rstrip("/"), self.round, self.earlier)


class JournalWriter:
    """One task's view of a journal."""

    def __init__(self, files: pafs.FileSystem, path: str, round: str, earlier: tuple[str, ...]):
        self.files, self.path, self.round, self.earlier = files, path, round, earlier
        files.create_dir(f"{path}/{round}", recursive=True)

    def _read(self, path: str) -> dict | None:
        if self.files.get_file_info(path).type != pafs.FileType.File:
            return None
        with self.files.open_input_stream(path) as f:
            return json.loads(f.read())

    def find(self, key: str) -> dict | None:
        """The ``reply`` or ``error`` that stands for ``key``."""
        found = self._read(f"{self.path}/{self.round}/{key}")
        if found is not None:
            return found
        for round in self.earlier:
            found = self._read(f"{self.path}/{round}/{key}")
            if found is not None and found.get("error") is None:
                self.record(key, found)
                self.files.delete_file(f"{self.path}/{round}/{key}")
                return found
        return None

    def record(self, key: str, found: dict) -> None:
        """Whole or not at all: written aside, then moved."""
        aside = f"{self.path}/{self.round}/.{key}.{uuid.uuid4().hex}"
        with self.files.open_output_stream(aside) as f:
            f.write(json.dumps(found).encode())
        self.files.move(aside, f"{self.path}/{self.round}/{key}")


def begin(spark: SparkSession, folder: str, round: str) -> Journal:
    """A round's journal, which knows the rounds that were left open."""
    fs, path = shared.hadoop(spark, folder)
    names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
    return Journal(folder, round, tuple(sorted(n for n in names if n != round)))


def tidy(spark: SparkSession, journal: Journal) -> None:
    """Drop the folders of earlier rounds from which all answers have been taken over."""
    for name in journal.earlier:
        fs, path = shared.hadoop(spark, f"{journal.folder}/{name}")
        if fs.exists(path) and not any(not x.getPath().getName().startswith(".") for x in fs.listStatus(path)):
            fs.delete(path, True)
