"""The prompt that asks for a rubric reply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CATEGORIES, FLAWS

NO_FACE = "未检测到人脸"
HEAD = "You judge photographs. Look at the whole picture and answer with one JSON object.\n"
FACES = "{FACES}\nDecide which person, if any, is the subject; closed eyes of the subject are a flaw, those of passers-by are not.\n"
PLAIN = "No person needs judging; attend to the scene.\n"
TASK = (
    "Give composition_score, color_score, lighting_score and overall_aesthetic_score from 1 to 10, a short reason, "
    "hard_flaws (any of: {FLAWS}) and a category (one of: {CATEGORIES}).\n"
)


def text(face_summary: str | None) -> str:
    """prompt() of one picture inside a task."""
    task = TASK.replace("{FLAWS}", " / ".join(FLAWS)).replace("{CATEGORIES}", " / ".join(CATEGORIES))
    named = bool(face_summary) and NO_FACE not in face_summary
    return HEAD + (FACES.replace("{FACES}", face_summary) if named else PLAIN) + task


def prompt(face_summary: Column) -> Column:
    """With the faces' description where there is one that names faces, else the short form."""
    task = TASK.replace("{FLAWS}", " / ".join(FLAWS)).replace("{CATEGORIES}", " / ".join(CATEGORIES))
    before, after = FACES.split("{FACES}")
    named = (F.coalesce(face_summary, F.lit("")) != "") & ~F.contains(face_summary, F.lit(NO_FACE))
    return F.concat(F.lit(HEAD), F.when(named, F.concat(F.lit(before), face_summary, F.lit(after))).otherwise(F.lit(PLAIN)), F.lit(task))
