"""Scores of faces, rubric replies and platforms, and their fusion, as column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config
from ..config import CATEGORIES, CATEGORY_ALIASES, DIVERSITY_PENALTY, EYES_CLOSED, FLAW_SUFFIX, FLAWED_MOST, FLAWS, FUSION, SPACES
from .quality import bound

SCORES = ("composition_score", "color_score", "lighting_score", "overall_aesthetic_score")


def face_size(ratio: Column) -> Column:
    near, half, far = config.FACE_SIZES
    return F.when(ratio >= 0.30, near).when(ratio >= 0.10, half).otherwise(far)


def face_clarity(ratio: Column, clarity: Column) -> Column:
    sharp, soft, blurred, small = config.FACE_CLEAR
    return F.when(ratio < 0.10, small).when(clarity >= 0.15, sharp).when(clarity >= 0.10, soft).otherwise(blurred)


def filled(template: str, words: dict[str, Column]) -> Column:
    """A template with its fields in braces replaced by columns."""
    parts = [F.concat(F.lit(text), words[field]) if field else F.lit(text) for text, field, _, _ in string.Formatter().parse(template)]
    return F.concat(*parts)


def face_summary(count: Column, ratio: Column, second: Column, clarity: Column, main_blink: Column, any_blink: Column) -> Column:
    """The neutral description of the faces of a picture that goes into the rubric's prompt."""
    yes = lambda b: F.when(b, config.YES).otherwise(config.NO)
    words = {"count": count.cast("string"), "main": yes(main_blink), "some": yes(any_blink), "clear": face_clarity(ratio, clarity), "size": face_size(ratio)}
    by_spread = lambda even, apart, unlike: F.when(second >= 0.7, filled(even, words)).when(second < 0.5, filled(apart, words)).otherwise(filled(unlike, words))
    few = by_spread(config.FACES_FEW_EVEN, config.FACES_FEW_APART, config.FACES_FEW_UNLIKE)
    many = by_spread(config.FACES_MANY_EVEN, config.FACES_MANY_APART, config.FACES_MANY_UNLIKE)
    return F.when(F.coalesce(count, F.lit(0)) == 0, config.FACES_NONE).when(count == 1, filled(config.FACES_ONE, words)).when(count <= 9, few).otherwise(many)


def face_overall(clarity: Column, smile: Column, main_blink: Column) -> Column:
    return clarity * 0.5 + smile * 0.3 + F.when(main_blink, 0.0).otherwise(0.2)


def face_flag(has_face: Column, ratio: Column, clarity: Column, main_blink: Column) -> Column:
    """A flaw beyond doubt: the main face blinks, or is large and clearly blurred."""
    return main_blink | (has_face & (ratio > 0.10) & (clarity < 0.10))


def face_score(count: Column, ratio: Column, overall: Column) -> Column:
    """Six faces or more that are all small are surroundings, and don't count."""
    return F.when((count >= 6) & (ratio < 0.10), 0.0).otherwise(overall)


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def rubric(reply: Column) -> Column:
    """The first object of a reply whose four scores are numbers, with clamped scores (null if there is none).

    Tried are the whole reply, without white space around it, where it starts with a brace, then every innermost
    pair of braces. Each is parsed once.
    """
    kind = "struct<" + ",".join(f"{s}:string" for s in SCORES) + ",reason:string,category:string,hard_flaws:array<string>>"
    tried = lambda t: F.concat(F.when(t.startswith("{"), F.array(t)).otherwise(F.array().cast("array<string>")), F.regexp_extract_all(t, F.lit(r"(\{[^{}]*\})"), 1))
    good = lambda o: F.greatest(*[o[s].try_cast("double").isNull().cast("int") for s in SCORES]) == 0
    first = F.get(F.filter(F.transform(bound(stripped(reply), tried), lambda x: F.from_json(x, kind)), good), 0)

    def made(o: Column) -> Column:
        score = lambda s: F.round(F.greatest(F.lit(1.0), F.least(F.lit(10.0), o[s].try_cast("double"))), 1).alias(s)
        reason = F.substring(stripped(o["reason"]), 1, 200)
        return F.when(o.isNotNull(), F.struct(*map(score, SCORES), reason.alias("reason"), category(o["category"]).alias("category"), flaws(o["hard_flaws"]).alias("hard_flaws")))

    return bound(first, made)


def flaws(found: Column) -> Column:
    """Known flaws only, without white space around them, each once, the first five."""
    known = F.array(*map(F.lit, FLAWS))
    return F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x: stripped(x)), lambda x: F.array_contains(known, x))), 1, 5)


def category(name: Column) -> Column:
    """The name itself if it is a category, else the category that it is another name of, else null."""
    others = F.create_map(*[F.lit(x) for pair in CATEGORY_ALIASES.items() for x in pair])
    name = stripped(name)
    return F.coalesce(F.when(name.isin(CATEGORIES), name), others[name])


def clamped(score: Column, flagged: Column, found: Column) -> Column:
    """6 at most where a face is flagged or closed eyes are among the flaws found."""
    return F.when(flagged | F.exists(F.coalesce(found, F.array().cast("array<string>")), lambda x: x.contains(EYES_CLOSED)), F.least(score, F.lit(FLAWED_MOST))).otherwise(score)


def clamp_reason(reason: Column, hit: Column) -> Column:
    bare = FLAW_SUFFIX.strip("（）")
    reason = F.coalesce(reason, F.lit(""))
    return F.when(~hit, reason).when(reason == "", bare).otherwise(F.concat(reason, F.lit(FLAW_SUFFIX)))


def platform_score(dims: dict[str, Column], weights: dict[str, Column], overall: Column) -> Column:
    total = sum(weights.values(), F.lit(0.0))
    return F.when(total <= 0, overall).otherwise(sum((dims[k] * weights[k] for k in dims), F.lit(0.0)) / total)


def effective(vlm: Column, dims: Column) -> Column:
    """Null where the rubric gave no score (0)."""
    return F.when(vlm > 0, dims * 0.7 + vlm * 0.3)


def divergence(value: Column, overall: Column) -> Column:
    return F.round(F.abs(value - overall), 4)


def weights(has_face: Column, has_vlm: Column) -> dict[str, Column]:
    """Weights of the fusion; the face's goes to the others in proportion where there is none or a rubric score."""
    counts = has_face & ~has_vlm
    rest = 1.0 - FUSION["face"]
    return {k: F.when(counts, w).otherwise(0.0 if k == "face" else w / rest) for k, w in FUSION.items()}


def fused(has_vlm: Column, value: Column, topiq: Column, face: Column, objective: Column) -> Column:
    w = weights(face > 0, has_vlm)
    return w["vlm"] * F.when(has_vlm, value).otherwise(topiq) + w["topiq"] * topiq + w["face"] * 10.0 * face + w["objective"] * 10.0 * objective


def penalised(score: Column, close: Column) -> Column:
    return F.when(close, score * (1.0 - DIVERSITY_PENALTY)).otherwise(score)
