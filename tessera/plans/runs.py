"""Whole runs of the two boards: layers in turn, each a stage that a later run can resume, redo or extend."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..config import CLUSTER_BITS, DIVERSITY_BITS
from ..functions import prompts, scores
from ..functions.names import display
from ..operators import close, merge, ranking
from ..settings import Settings
from ..sources import manifests
from ..sources.shared import cut
from . import boards, sinks
from .plugins import fallback
from .stages import Stages, alone

Layer = Callable[[DataFrame], DataFrame]
Tell = Callable[[dict], None]
FACES = "face_overall double, face_count int, ratio double, clarity double, second_ratio double, any_blink boolean, main_blink boolean, has_face boolean"
#: What is counted in passing of each layer's rows.
COUNTS: dict[str, dict[str, str]] = {
    "l1": {"total": "true", "rejected": "rejected", "kept": "not rejected"},
    "l2": {"total": "true", "clusters": "id = cluster_id"},
    "l4": {"total": "true", "faces": "has_face", "blinks": "any_blink"},
    "topiq": {"total": "true", "errors": "error is not null"},
    "vlm": {"total": "true", "scored": "vlm > 0"},
}


@dataclass
class Mode:
    """What a run does again; see mode_of()."""

    again: set[str] = field(default_factory=set)
    force: bool = False
    incremental: bool = False


def mode_of(done: set[str], force: bool = False, rerun: list[str] = [], incremental: bool = False, skip_l1: bool = False, usable: bool = True) -> Mode:  # noqa: B006
    """Which mode wins.

    force ignores what is there. skip_l1 redoes everything from l1 on. incremental wins over both reruns, which
    it clears; without a usable earlier run of the current version it is an ordinary run with nothing to redo.
    """
    if force:
        return Mode(force=True)
    again = merge.rerun_closure(["l1"] if skip_l1 else rerun)
    return Mode(incremental=usable and "l1" in done) if incremental else Mode(again=again)


def _no(kinds: str) -> list[Column]:
    return [F.lit(0).cast(k).alias(c) for c, k in (x.split() for x in kinds.split(", "))]


def faceless(rows: DataFrame) -> DataFrame:
    """``rows`` (id) as pictures without a face."""
    return rows.select("id", *_no(FACES))


def unscored(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.lit(0.0).alias("topiq"), F.lit(None).cast("string").alias("error"))


def stretched(scored: DataFrame) -> DataFrame:
    """id, topiq, error of a model's batch: scores of rows without an error are stretched over their order; a row without a score has 0."""
    rows = scored.select("id", F.coalesce(F.col("topiq").cast("double"), F.lit(0.0)).alias("topiq"), F.col("error").cast("string").alias("error"))
    return ranking.stretch(rows, "topiq", F.col("error").isNull() & (F.col("topiq") > 0))


def unjudged(shown: DataFrame, topiq: DataFrame) -> DataFrame:
    """What a rubric leaves of ``shown`` (id) without a reply: dimensions of 5 (none where the model failed), no score."""
    rows = shown.join(topiq.select("id", "error"), "id")
    empty = {"vlm": F.lit(0.0), "reason": F.lit(""), "category": F.lit(None).cast("string"), "hard_flaws": F.array().cast("array<string>"), "flagged": F.lit(False)}
    return boards.rubric_applied(rows.withColumns(empty | {"r": scores.rubric(F.lit(None).cast("string"))})).drop("r")


def judged(judge: Layer | None, shown: DataFrame, l4: DataFrame, topiq: DataFrame) -> DataFrame:
    """``shown`` (id) with what ``judge`` says of pictures without an error; its scores are stretched over these rows."""
    base = unjudged(shown, topiq)
    if judge is None:
        return base
    seen = base.where("error is null").select("id").join(l4, "id", "left")
    told = scores.face_summary(F.col("face_count"), F.col("ratio"), F.col("second_ratio"), F.col("clarity"), F.col("main_blink"), F.col("any_blink"))
    flag = F.coalesce(scores.face_flag(F.col("has_face"), F.col("ratio"), F.col("clarity"), F.col("main_blink")), F.lit(False))
    flags = seen.select("id", flag.alias("_flag"))
    replies = judge(seen.select("id", prompts.prompt(told).alias("prompt")))
    rows = base.join(flags, "id", "left").withColumn("flagged", F.coalesce("_flag", F.lit(False))).drop("_flag")
    rows = rows.join(replies.select("id", "reply"), "id", "left").withColumn("r", scores.rubric(F.col("reply"))).drop("reply")
    return boards.vlm_settled(boards.rubric_applied(rows).drop("r"))


def say(tell: Tell | None, **event: object) -> None:
    """Tell what happens; what goes wrong there is not the run's trouble."""
    try:
        if tell is not None:
            tell(event)
    except Exception:
        pass


class Layers:
    """The stages of one run, and what becomes of them when a layer fails."""

    def __init__(self, stages: Stages, mode: Mode, tell: Tell | None) -> None:
        self.stages, self.mode, self._tell = stages, mode, tell
        self.old = {} if mode.force else {s: stages.load(s) for s in stages.done()}

    def new_of(self, name: str, rows: DataFrame) -> DataFrame:
        """In an incremental run the ``rows`` (id) that the stage doesn't hold, else all."""
        return merge.unseen(rows, self.old[name]) if self.mode.incremental and name in self.old else rows

    def stage(self, name: str, make: Callable[[], DataFrame], otherwise: Callable[[], DataFrame], tries: int = 1, overwrite: list[str] = [], whole: bool = False) -> DataFrame:  # noqa: B006
        """The stage as it is where it needn't be made, else made and saved.

        make: rows of all items, in an incremental run of those without rows, which join the old ones (whole: of all items
        there too, in place of the old ones). overwrite: in a rerun of this layer alone only these columns are taken, from rows
        without an error. A layer that fails
        ``tries`` times costs no old row: ``otherwise()``, rows of all items, stands in for items without one only.
        Each layer is written once, and counted while it is written.
        """
        old, mode = self.old.get(name), self.mode
        if old is not None and name not in mode.again and not mode.incremental:
            return old
        say(self._tell, event="layer_start", layer=name)

        def made() -> DataFrame:
            rows = make()
            if old is not None and mode.incremental and not whole:
                return merge.keep_old(old, rows)
            return merge.overwrite(old, rows, overwrite) if old is not None and overwrite and mode.again == {name} else rows

        for _ in range(tries):
            seen = Observation()
            try:
                rows = self.stages.save(name, made().observe(seen, *[F.count_if(F.expr(test)).alias(k) for k, test in COUNTS[name].items()]))
                say(self._tell, event="layer_end", layer=name, failed=False, **seen.get)
                return rows
            except Exception as error:
                say(self._tell, event="layer_failed", layer=name, error=str(error)[:500])
        rows = self.stages.save(name, otherwise() if old is None else merge.keep_old(old, otherwise()), skipped=True)
        say(self._tell, event="layer_end", layer=name, failed=True)
        return rows


@dataclass
class Photos:
    """The layers that a run is made of.

    measure: items (id, ...) to id, date_key, h, sharpness, overall, rejected, ...; faces: id to id, face_overall, face_count, ratio,
    clarity, second_ratio, any_blink, main_blink, has_face; score: id to id, topiq, error; judge: (id, prompt) to (id, reply), None
    where there is no judge. tell: is told when a layer starts, fails and ends, with counts of its rows.
    """

    measure: Layer
    faces: Layer
    score: Layer
    judge: Layer | None = None
    tell: Tell | None = None

    def run(self, stages: Stages, items: DataFrame, force: bool = False, rerun: list[str] = [], incremental: bool = False, skip_l1: bool = False, same_date: bool = True, platform: str | None = None, n: int | None = None, bits: int = CLUSTER_BITS, near: int = DIVERSITY_BITS) -> DataFrame:  # noqa: B006
        """The board of ``items`` (id, ...); platform and n: those of the session's Settings, if they aren't given.

        Layers that fail are stood in for: measures by zeros with nothing rejected, clusters by single items, faces
        by none, scores, after a second try, by zeros; the manifest says which. Rows of an earlier run stay in every mode but
        force. incremental: only items that no earlier run knows are measured, all are clustered, and only representatives
        without scores are scored; their scores are stretched among themselves. A rerun of the scores alone overwrites
        those of rows without an error.
        """
        settings = Settings.of(items.sparkSession)
        platform, n = platform or settings.platform, n or settings.top_n
        with alone(stages.root):
            mode = mode_of(stages.done(), force, rerun, incremental, skip_l1)
            run = Layers(stages, mode, self.tell)
            if mode.incremental:
                mode.incremental = not merge.unseen(items, run.old["l1"]).isEmpty()
            unmeasured = lambda: items.select("id", F.lit(None).cast("string").alias("date_key"), F.lit(None).cast("bigint").alias("h"), *_no("sharpness double, overall double, rejected boolean"))
            l1 = run.stage("l1", lambda: self.measure(run.new_of("l1", items)), unmeasured)
            kept = boards.passed(l1, skip_l1)
            block = ["date_key"] if same_date else []
            l2 = run.stage("l2", lambda: close.clusters(kept, bits, block), lambda: kept.select("id", F.col("id").alias("cluster_id")), whole=True)
            shown = ranking.representatives(ranking.summaries(l2.join(kept.select("id", "sharpness"), "id"))).select("id")
            l4 = run.stage("l4", lambda: self.faces(run.new_of("l4", shown)), lambda: faceless(shown))
            topiq = run.stage("topiq", lambda: stretched(self.score(run.new_of("topiq", shown))), lambda: unscored(shown), tries=2, overwrite=["topiq"])
            vlm = run.stage("vlm", lambda: judged(self.judge, run.new_of("vlm", shown), l4, topiq), lambda: unjudged(shown, topiq))
            rows = shown.join(topiq.select("id", "topiq"), "id").join(vlm.drop("error"), "id")
            found = boards.looked_up(rows, l4, l1, l1)
            return boards.photo_board(found, platform, n, near)


@dataclass
class Videos:
    """The layers of a run of the video board: as those of Photos, but frames were measured when they were taken."""

    faces: Layer
    score: Layer
    judge: Layer | None = None
    tell: Tell | None = None

    def run(self, manifest: DataFrame, files: DataFrame | None = None, folder: str | None = None, platform: str | None = None, slots: int | None = None, bits: int = CLUSTER_BITS, near: int = DIVERSITY_BITS, most: float | None = None) -> DataFrame:
        """The frames that the board shows, by their final score: filename, source_video, timestamp, final, rank, name and scores.

        manifest: as of manifests.latest() or read(), one row a file name; files: (name) of the frames that exist, None: all
        do. Frames of all videos are clustered together, without dates; faces and scores of representatives are made,
        and judged, stretched and fused as for photos, but small groups of faces count; near frames of a better one are lowered
        once, and each video gets slots by its duration. A layer that fails is stood in for as in Photos. With a
        ``folder`` the board is written there. Without frames the result is empty. Jobs run when this is called.
        """
        settings = Settings.of(manifest.sparkSession)
        platform, slots = platform or settings.platform, slots or settings.video_slots
        rows = manifest if files is None else manifests.existing(manifest, files)
        frames = ranking.global_rank(rows, [F.col("filename")], "id")
        frames = cut(frames.withColumn("h", F.when(F.length("phash") == 16, F.conv("phash", 16, -10).cast("bigint"))))
        skipped: list[str] = []
        l2 = fallback(lambda: close.clusters(frames.select("id", "h"), bits), lambda: frames.select("id", F.col("id").alias("cluster_id")), skipped, "l2")
        shown = cut(ranking.representatives(ranking.summaries(l2.join(frames.select("id", "sharpness"), "id"))).select("id"))
        named = shown.join(frames, "id")
        l4 = fallback(lambda: self.faces(named), lambda: faceless(shown), skipped, "l4")
        topiq = fallback(lambda: stretched(self.score(named)), lambda: unscored(shown), skipped, "topiq", tries=2)
        vlm = fallback(lambda: judged(self.judge, shown, l4, topiq), lambda: unjudged(shown, topiq), skipped, "vlm")
        face = l4.select("id", F.col("face_overall").alias("face"))
        found = named.withColumnRenamed("overall", "objective").join(face, "id", "left").join(topiq.select("id", "topiq"), "id").join(vlm.drop("error"), "id")
        scored = cut(boards.diverse(boards.fused(found, platform), [F.col("topiq").desc(), F.col("id")], near).drop("rank"))
        lengths = scored.groupBy(F.col("source_video").alias("video")).agg(F.max_by("duration", F.struct(F.col("topiq"), -F.col("id"))).alias("duration"))
        quota = ranking.quotas(lengths, slots, most).select(F.col("video").alias("source_video"), "quota")
        best = [F.col("final").desc(), F.col("topiq").desc(), F.col("id")]
        chosen = ranking.top_each(scored.join(quota, "source_video"), "source_video", best, F.col("quota"), max(1, slots)).drop("rank_in_group", "quota")
        board = ranking.global_rank(chosen, best)
        board = board.withColumn("name", display(F.col("rank"), F.col("filename"), "v"))
        if folder is not None:
            sinks.write_video_board(board, scored, folder)
        say(self.tell, event="board", skipped=skipped)
        return board.orderBy("rank")
