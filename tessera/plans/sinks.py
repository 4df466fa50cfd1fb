"""Boards written as JSON, with display names and a summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.names import display
from ..operators.ranking import global_rank

FIELDS = ["path", "filename", "aesthetic", "overall", "final", "category", "source_video", "timestamp"]


def write_board(items: DataFrame, folder: str, n: int, video: bool = False) -> None:
    """The first ``n`` (``ranking``), all (``full_ranking``) and the display names of the first (``names``).

    items: final, path, filename and what else a board shows. ``ranking`` keeps the plain file names. All
    are sorted by range and written in parallel; part files follow each other.
    """
    prefix, mode = ("v", "video_") if video else ("", "")
    order = [F.col("final").desc(), F.col("path")]
    ranked = global_rank(items, order)
    shown = [c for c in FIELDS if c in items.columns]
    ranked.orderBy("rank").drop("rank").write.mode("overwrite").json(f"{folder}/{mode}full_ranking")
    top = ranked.where(F.col("rank") <= n)
    top.orderBy("rank").select(*shown).write.mode("overwrite").json(f"{folder}/{mode}ranking")
    top.orderBy("rank").select("path", display(F.col("rank"), F.col("filename"), prefix).alias("name")).write.mode("overwrite").json(f"{folder}/{mode}names")


def write_video_board(board: DataFrame, full: DataFrame, folder: str) -> None:
    """``video_ranking`` (rows of ``board`` by rank, file names as they are shown), ``video_full_ranking`` (all of ``full`` by final
    score) and ``video_names`` (filename, name). Both have filename, topiq, final, category, source_video and timestamp."""
    scores = lambda d: d.withColumns({"aesthetic": F.col("topiq"), "overall": F.col("topiq")})
    ranked = global_rank(scores(full), [F.col("final").desc(), F.col("filename")], "_place")
    ranked.orderBy("_place").drop("_place").write.mode("overwrite").json(f"{folder}/video_full_ranking")
    shown = scores(board).withColumn("plain", F.col("filename")).withColumn("filename", F.col("name"))
    shown.orderBy("rank").select(*[c for c in FIELDS if c in shown.columns]).write.mode("overwrite").json(f"{folder}/video_ranking")
    shown.orderBy("rank").select(F.col("plain").alias("filename"), "name").write.mode("overwrite").json(f"{folder}/video_names")


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def copy_shown(names: DataFrame, folder: str) -> None:
    """Copy the files of ``names`` (path, name) into ``folder`` under their display names, task by task; both may lie in any store.

    A copy appears whole or not at all. Display copies of earlier runs (numbered names) that aren't among them go afterwards.
    """

    def some(rows) -> None:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        for path, name in rows:
            source, at = _store(path)
            with source.open_input_stream(at) as read, store.open_output_stream(f"{base}/.{name}.part") as out:
                while part := read.read(1 << 20):
                    out.write(part)
            store.move(f"{base}/.{name}.part", f"{base}/{name}")

    names.select("path", "name").foreachPartition(some)
    listed = names.sparkSession.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    old = listed.where(F.col("name").rlike(r"^v?[0-9]{2,}_")).join(names.select("name"), "name", "left_anti")

    def gone(rows) -> None:
        store, base = _store(folder)
        for (name,) in rows:
            store.delete_file(f"{base}/{name}")

    old.foreachPartition(gone)


def summary(measured: DataFrame, clusters: DataFrame, board: DataFrame) -> DataFrame:
    """One row: total, rejected, merged, ranked, output."""
    found = measured.agg(F.count("*").alias("total"), F.count_if("rejected").alias("rejected")).first().asDict()
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("n"))
    found |= sizes.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("merged"), F.count("*").alias("ranked")).first().asDict()
    kind = "total bigint, rejected bigint, merged bigint, ranked bigint, output bigint"
    return measured.sparkSession.createDataFrame([(*found.values(), board.count())], kind)


class Progress(StreamingQueryListener):
    """Passes what happens to a stream to ``tell``; what goes wrong there is not the stream's trouble."""

    def __init__(self, tell: Callable[[dict], None]) -> None:
        self._tell = tell

    def _say(self, **event: object) -> None:
        try:
            self._tell(event)
        except Exception:
            pass

    def onQueryStarted(self, event) -> None:
        self._say(event="started", id=str(event.id))

    def onQueryProgress(self, event) -> None:
        self._say(event="progress", id=str(event.progress.id), rows=event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._say(event="terminated", id=str(event.id), error=event.exception)
