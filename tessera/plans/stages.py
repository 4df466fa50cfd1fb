"""Stages of a run kept as Parquet tables with a manifest, to resume, rerun and extend runs.

A save writes a folder of its own, and then a new manifest that names it. The newest whole manifest counts, so
readers see the last stage that was saved whole whatever breaks: data without a manifest belong to nothing, and a
manifest that isn't whole is passed over. Folders that no manifest within reach names any more are deleted after the
next save.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import rerun_closure

VERSION = 3
ORDER = ("l1", "l2", "l4", "topiq", "vlm")
#: Manifests that are kept, the newest among them: a reader that has just taken one finds its stages for as many saves.
KEPT = 3
_KIND = "version int, stage string, seq bigint, failed bigint, folder string"
_RUNNING: set[str] = set()
_GUARD = threading.Lock()


class Busy(RuntimeError):
    """A run of the same root is going on."""


@contextmanager
def alone(root: str) -> Iterator[None]:
    """One run at a time for each root of this driver; a second one is told so at once."""
    with _GUARD:
        if root in _RUNNING:
            raise Busy(root)
        _RUNNING.add(root)
    try:
        yield
    finally:
        with _GUARD:
            _RUNNING.discard(root)


class Stages:
    """Named stages below ``root``, a path that all executors reach. A stage counts once a manifest names its folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _store(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        """The whole manifests, newest first."""
        store, at = self._store(), self._path("manifests")
        if not store.exists(at):
            return []
        named = [s.getPath().getName() for s in store.listStatus(at)]
        return sorted((int(n) for n in named if n.isdigit() and store.exists(self._path("manifests", n, "_SUCCESS"))), reverse=True)

    def _rows(self, number: int) -> list[dict]:
        return [r.asDict() for r in self.spark.read.schema(_KIND).json(f"{self.root}/manifests/{number:09d}").collect()]  # a row a stage

    def _earlier(self) -> list[dict]:
        """What a run of an earlier version left: marks of one stage and run each, stages in folders of their names."""
        try:
            marks = self.spark.read.schema("version int, stage string, seq bigint, skipped boolean").json(f"{self.root}/manifest").collect()
        except Exception as error:  # none
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return []
        found: dict[str, dict] = {}
        for r in sorted(marks, key=lambda r: r["seq"] or 0):
            before = found.get(r["stage"], {"failed": None})["failed"]
            failed = before if before is not None or not r["skipped"] else r["seq"]
            found[r["stage"]] = {"version": r["version"], "stage": r["stage"], "seq": r["seq"], "failed": failed, "folder": r["stage"]}
        return list(found.values())

    def _now(self) -> dict[str, dict]:
        numbers = self._numbers()
        return {r["stage"]: r for r in (self._rows(numbers[0]) if numbers else self._earlier())}

    def manifest(self) -> DataFrame:
        """version, stage, seq (of the last save), failed (seq of the first failure, null without) and folder of each stage."""
        return self.spark.createDataFrame([tuple(r.values()) for r in self._now().values()], _KIND)

    def done(self) -> set[str]:
        """Stages that can be used; of a run of version 1 only those up to clustering."""
        return {s for s, r in self._now().items() if (r["version"] or 0) >= 2 or s in ("l1", "l2")}

    def _commit(self, stage: str, folder: str, failed: bool) -> None:
        """A new manifest: the one before with ``stage`` at ``folder``. Of two writers of one number one fails."""
        numbers, rows = self._numbers(), self._now()
        seq = max((r["seq"] or 0 for r in rows.values()), default=0) + 1
        first = rows.get(stage, {}).get("failed")
        rows[stage] = {"version": VERSION, "stage": stage, "seq": seq, "failed": seq if failed and first is None else first, "folder": folder}
        made = self.spark.createDataFrame([tuple(r.values()) for r in rows.values()], _KIND)
        taken = max([*numbers, *self._begun()], default=0)
        made.coalesce(1).write.json(f"{self.root}/manifests/{taken + 1:09d}")
        self._tidy()

    def _begun(self) -> list[int]:
        store, at = self._store(), self._path("manifests")
        return [int(s.getPath().getName()) for s in store.listStatus(at) if s.getPath().getName().isdigit()] if store.exists(at) else []

    def _tidy(self) -> None:
        """Delete manifests beyond KEPT, and the folders that only those name. What goes wrong here is tried again next time."""
        try:
            numbers = self._numbers()
            kept = {r["folder"] for n in numbers[:KEPT] for r in self._rows(n)}
            for n in numbers[KEPT:]:
                for folder in {r["folder"] for r in self._rows(n)} - kept:
                    self._store().delete(self._path(folder), True)
                self._store().delete(self._path("manifests", f"{n:09d}"), True)
        except Exception:
            pass

    def save(self, stage: str, df: DataFrame, skipped: bool = False) -> DataFrame:
        """Write a stage, which may be made from itself, then the manifest that names it. A save that breaks leaves the stage as it was.

        skipped: its layer failed, and ``df`` stands for it.
        """
        folder = f"{stage}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        self._commit(stage, folder, skipped)
        return self.load(stage)

    add = save

    def keep(self, stage: str) -> DataFrame:
        """The stage as it is, with a note that its layer failed."""
        self._commit(stage, self._now()[stage]["folder"], True)
        return self.load(stage)

    def skipped(self) -> list[str]:
        """Layers that failed in any run, in the order of their first failure."""
        return [r["stage"] for r in sorted(self._now().values(), key=lambda r: r["failed"] or 0) if r["failed"] is not None]

    def load(self, stage: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self._now()[stage]['folder']}")

    def run(self, makers: dict[str, Callable[[dict[str, DataFrame]], DataFrame]], rerun: list[str] = [], force: bool = False) -> dict[str, DataFrame]:  # noqa: B006
        """Each stage in ORDER: loaded if it is done and neither it nor what it rests on runs again, else made."""
        again, done, made = rerun_closure(rerun), set() if force else self.done(), {}
        for stage in (s for s in ORDER if s in makers):
            if stage in done and stage not in again:
                made[stage] = self.load(stage)
            else:
                made[stage] = self.save(stage, makers[stage](made))
        return made
