"""The registered queries of the curation operators, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .config import PLATFORMS
from .functions import faces, fingerprints, names, prompts, scores
from .operators import close, frames as frame_ops, merge, ranking
from .plans import boards, runs
from .sources import images, manifests, tables
from .sources.shared import table
from .streaming import arrivals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CLUSTER_BITS, NEAR_BITS, SLOTS = 20, 18, 1000

_TILES = """tiles AS (
  SELECT vec_id AS id, label AS date_key, embedding AS e,
         list_transform(embedding, lambda x: CAST(greatest(0, least(255, floor(128 + 18 * x::DOUBLE + (label - 4.5::DOUBLE) * 26))) AS INT)) AS p
  FROM embeddings
)"""
_MEASURES = _TILES + """, laps AS (
  SELECT *, list_transform(range(64), lambda i: p[abs(i // 8 - 1) * 8 + i % 8 + 1] + p[(7 - abs(6 - i // 8)) * 8 + i % 8 + 1]
         + p[i // 8 * 8 + abs(i % 8 - 1) + 1] + p[i // 8 * 8 + 7 - abs(6 - i % 8) + 1] - 4 * p[i + 1]) AS l FROM tiles
), parts AS (
  SELECT *, CAST(64 * list_sum(list_transform(l, lambda x: x * x)) - list_sum(l) * list_sum(l) AS DOUBLE) / 4096 AS sharpness,
         CAST(list_sum(p) AS DOUBLE) / 64 AS mean, len(list_filter(p, lambda x: x > 240))::DOUBLE / 64 AS over,
         len(list_filter(p, lambda x: x < 15))::DOUBLE / 64 AS under FROM laps
), scores AS (
  SELECT *, CASE WHEN mean BETWEEN 70 AND 180 THEN 1.0::DOUBLE WHEN mean < 70 THEN greatest(0, 1 - (70 - mean) / 128::DOUBLE)
         ELSE greatest(0, 1 - (mean - 180) / 128::DOUBLE) END AS exposure,
         CASE WHEN sharpness = 0 THEN 1.0::DOUBLE ELSE least(mean / sqrt(sharpness) / 100::DOUBLE, 1) END AS noise FROM parts
), measures AS (
  SELECT *, least(sharpness / 500::DOUBLE, 1) * 0.4::DOUBLE + exposure * 0.3::DOUBLE + noise * 0.3::DOUBLE AS overall,
         concat_ws(', ', CASE WHEN sharpness < 70 THEN '模糊' END, CASE WHEN over > 0.4::DOUBLE THEN '过曝' END, CASE WHEN under > 0.8::DOUBLE THEN '欠曝' END) AS reason FROM scores
)"""
_BITS = """bits AS (
  SELECT vec_id AS id, label AS date_key, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS h FROM embeddings
)"""
_SCORED = _MEASURES + """, scored AS (
  SELECT id, overall AS objective, 1 + (id * 7 % 91) / 10::DOUBLE AS composition, 1 + (id * 13 % 91) / 10::DOUBLE AS color, 1 + (id * 29 % 91) / 10::DOUBLE AS lighting,
         2 + (id * 37 % 701) / 100::DOUBLE AS topiq, CASE WHEN id % 4 = 0 THEN 0 ELSE 1 + (id * 17 % 91) / 10::DOUBLE END AS vlm,
         CASE WHEN id % 3 = 0 THEN 0 ELSE (id * 11 % 101) / 100::DOUBLE END AS face, CAST(id % 12 AS INT) AS face_count, (id * 19 % 60) / 100::DOUBLE AS face_ratio,
         (id * 23 % 100) / 100::DOUBLE AS second_ratio, (id * 31 % 40) / 100::DOUBLE AS clarity, id % 7 = 0 AS main_blink, id % 5 = 0 OR id % 7 = 0 AS any_blink FROM measures
), fused AS (
  SELECT *, dims * 0.7::DOUBLE + vlm * 0.3::DOUBLE AS eff, vlm > 0 AS has_vlm, face > 0 AND NOT vlm > 0 AS f FROM (
    SELECT *, (composition * 0.35::DOUBLE + color * 0.30::DOUBLE + lighting * 0.20::DOUBLE) / 0.85::DOUBLE AS dims FROM scored)
), final AS (
  SELECT *, CASE WHEN f THEN 0.45::DOUBLE ELSE 0.45::DOUBLE / 0.85 END * CASE WHEN has_vlm THEN eff ELSE topiq END + CASE WHEN f THEN 0.30::DOUBLE ELSE 0.30::DOUBLE / 0.85 END * topiq
         + CASE WHEN f THEN 0.15::DOUBLE ELSE 0 END * 10 * face + CASE WHEN f THEN 0.10::DOUBLE ELSE 0.10::DOUBLE / 0.85 END * 10 * objective AS score FROM fused
)"""
_FRAMES = """frames AS (
  SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, ts, value AS sharpness, value / 500 AS overall, event_type = 'error' AS blink FROM events
), videos AS (
  SELECT user_id AS video, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000::DOUBLE AS duration FROM events GROUP BY user_id
)"""
_QUOTAS = _FRAMES + f""", given AS (
  SELECT video, duration, greatest(1, CAST(round_even({SLOTS} * duration / (SELECT sum(duration) FROM videos), 0) AS BIGINT)) AS q FROM videos
), back AS (
  SELECT video, count(*) AS n FROM (
    SELECT video, row_number() OVER (ORDER BY unit / duration DESC, video) AS k FROM (SELECT video, duration, unnest(range(2, q + 1)) AS unit FROM given WHERE q > 1))
  WHERE k <= (SELECT sum(q) - {SLOTS} FROM given) GROUP BY video
), quotas AS (
  SELECT g.video, CAST(g.q - coalesce(b.n, 0) + CASE WHEN g.video = (SELECT video FROM given ORDER BY duration DESC, video LIMIT 1)
         THEN greatest(0, {SLOTS} - (SELECT sum(q) FROM given)) ELSE 0 END AS BIGINT) AS quota FROM given g LEFT JOIN back b USING (video)
)"""
_REPLIES = """replies AS (
  SELECT event_id, '"composition_score": ' || (event_id % 10) || ', "color_score": "8.5", "lighting_score": 0, "overall_aesthetic_score": 12' AS s, event_id % 6 AS form FROM events
), texts AS (
  SELECT event_id, CASE form WHEN 0 THEN '{' || s || ', "hard_flaws": ["模糊", "模糊", " 闭眼 ", "unknown"], "category": "人文", "reason": " fine ", "more": {"a": 1}}'
    WHEN 1 THEN 'Here: {' || s || ', "category": "风景"} done' WHEN 2 THEN '{"a": 1} then {' || s || ', "category": "other", "reason": "b"}'
    WHEN 3 THEN 'no object' WHEN 4 THEN '{"composition_score": 5, "color_score": 5}' ELSE '{' || s || ', "hard_flaws": ["过曝"], "category": "宠物"}' END AS reply FROM replies
), objects AS (
  SELECT event_id, list_filter(list_concat(CASE WHEN starts_with(reply, '{') THEN [reply] ELSE [] END, regexp_extract_all(reply, '\\{[^{}]*\\}')),
    lambda x: CASE WHEN json_valid(x) THEN try_cast(x ->> '$.composition_score' AS DOUBLE) IS NOT NULL AND try_cast(x ->> '$.color_score' AS DOUBLE) IS NOT NULL
      AND try_cast(x ->> '$.lighting_score' AS DOUBLE) IS NOT NULL AND try_cast(x ->> '$.overall_aesthetic_score' AS DOUBLE) IS NOT NULL ELSE false END)[1] AS o FROM texts
)"""


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.measured(tables.tiles(spark, sf_dir))


def _six(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


@_query(f"WITH {_MEASURES} SELECT id, over, under FROM measures")
def q_exposure_ratios(spark, sf_dir):
    return _measured(spark, sf_dir).select("id", "over", "under")


@_query(f"WITH {_MEASURES} SELECT id, sharpness FROM measures")
def q_sharpness_variance(spark, sf_dir):
    return _measured(spark, sf_dir).select("id", "sharpness")


@_query(f"WITH {_MEASURES} SELECT id, mean, exposure FROM measures")
def q_exposure_score(spark, sf_dir):
    return _measured(spark, sf_dir).select("id", "mean", "exposure")


@_query(f"WITH {_MEASURES} SELECT id, round(noise, 6) AS noise FROM measures")
def q_noise_score(spark, sf_dir):
    return _measured(spark, sf_dir).select("id", *_six("noise"))


@_query(f"WITH {_MEASURES} SELECT id, round(overall, 6) AS overall FROM measures")
def q_objective_overall(spark, sf_dir):
    return _measured(spark, sf_dir).select("id", *_six("overall"))


@_query(f"WITH {_MEASURES} SELECT id, reason <> '' AS rejected, reason FROM measures")
def q_reject_reasons(spark, sf_dir):
    return _measured(spark, sf_dir).select("id", "rejected", F.array_join("reasons", ", ").alias("reason"))


@_query(f"WITH {_MEASURES} SELECT id, round_even(sharpness, 2) AS sharpness, round_even(exposure, 4) AS exposure FROM measures")
def q_rounded_measures(spark, sf_dir):
    return boards.rounded(_measured(spark, sf_dir)).select("id", "sharpness", "exposure")


@_query(f"WITH {_MEASURES} SELECT date_key, count(*) AS items FROM measures GROUP BY date_key")
def q_skip_filter(spark, sf_dir):
    return boards.passed(_measured(spark, sf_dir), skip=True).groupBy("date_key").agg(F.count("*").alias("items"))


@_query(f"WITH {_MEASURES} SELECT id, date_key, sharpness FROM measures WHERE reason = ''")
def q_kept(spark, sf_dir):
    return _measured(spark, sf_dir).where("not rejected").select("id", "date_key", "sharpness")


@_query(f"WITH {_MEASURES} SELECT date_key, count(*) AS items, count(*) FILTER (WHERE reason <> '') AS rejected, count(*) FILTER (WHERE contains(reason, '过曝')) AS over FROM measures GROUP BY date_key")
def q_reject_counts(spark, sf_dir):
    rows = _measured(spark, sf_dir).groupBy("date_key")
    return rows.agg(F.count("*").alias("items"), F.count_if("rejected").alias("rejected"), F.count_if(F.array_contains("reasons", "过曝")).alias("over"))


@_query("""SELECT vec_id AS id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS bits,
  lpad(lower(hex(CAST(list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(pow(2, i) AS HUGEINT) ELSE 0 END)) AS UBIGINT))), 16, '0') AS h FROM embeddings""")
def q_fingerprint_popcount(spark, sf_dir):
    h = F.col("h")
    return tables.tiles(spark, sf_dir).select("id", F.bit_count(h).alias("bits"), fingerprints.to_hex(fingerprints.from_hex(fingerprints.to_hex(h))).alias("h"))


@_query(f"WITH {_BITS} SELECT x.id AS a, y.id AS b, CAST(hamming(x.h, y.h) AS INT) AS distance FROM bits x JOIN bits y ON x.id < y.id AND hamming(x.h, y.h) <= {CLUSTER_BITS}")
def q_hamming_pairs(spark, sf_dir):
    return close.pairs(tables.tiles(spark, sf_dir), CLUSTER_BITS)


@_query(f"WITH {_BITS} SELECT x.id AS a, y.id AS b, CAST(hamming(x.h, y.h) AS INT) AS distance FROM bits x JOIN bits y ON x.id < y.id AND hamming(x.h, y.h) <= {config.CLUSTER_BITS}")
def q_default_pairs(spark, sf_dir):
    return close.pairs(tables.tiles(spark, sf_dir), config.CLUSTER_BITS)


@_query(f"WITH {_BITS} SELECT x.id AS a, y.id AS b, CAST(hamming(x.h, y.h) AS INT) AS distance FROM bits x JOIN bits y ON x.id < y.id AND x.date_key = y.date_key AND hamming(x.h, y.h) <= {CLUSTER_BITS}")
def q_same_date_pairs(spark, sf_dir):
    return close.pairs(tables.tiles(spark, sf_dir), CLUSTER_BITS, ["date_key"])


_COMPONENTS = _BITS + f""", links AS (
  SELECT x.id AS a, y.id AS b FROM bits x JOIN bits y ON x.id <> y.id AND hamming(x.h, y.h) <= {CLUSTER_BITS}
), reach AS (SELECT id, id AS root FROM bits UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id WHERE l.b > r.root
), found AS (SELECT id, min(root) AS cluster_id FROM reach GROUP BY id)"""
_CLUSTERS = f"WITH RECURSIVE {_COMPONENTS}"


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return close.clusters(tables.tiles(spark, sf_dir), CLUSTER_BITS)


@_query(f"{_CLUSTERS} SELECT id, cluster_id FROM found")
def q_components(spark, sf_dir):
    return _clusters(spark, sf_dir)


_MEMBERS = f"{_CLUSTERS}, {_MEASURES}, members AS (SELECT cluster_id, id, sharpness, row_number() OVER (PARTITION BY cluster_id ORDER BY sharpness DESC, id) AS k FROM found JOIN measures USING (id))"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir).join(_measured(spark, sf_dir).select("id", "sharpness"), "id")


@_query(f"{_MEMBERS} SELECT cluster_id, count(*) AS member_count, max(id) FILTER (WHERE k = 1) AS representative, string_agg(id, ',' ORDER BY id) AS members FROM members GROUP BY cluster_id")
def q_cluster_summary(spark, sf_dir):
    rows = _members(spark, sf_dir)
    # Only this report shows the members of a cluster as one text.
    listed = rows.groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda m: m.cast("string")), ",").alias("members"))
    return ranking.summaries(rows).join(listed, "cluster_id").select("cluster_id", "member_count", "representative", "members")


@_query(f"{_MEMBERS} SELECT cluster_id, id FROM members WHERE k <= 2")
def q_representatives(spark, sf_dir):
    return ranking.representatives(ranking.summaries(_members(spark, sf_dir)))


@_query(f"{_CLUSTERS} SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) - 1 AS number FROM (SELECT DISTINCT cluster_id FROM found)")
def q_cluster_numbers(spark, sf_dir):
    return ranking.numbered(_clusters(spark, sf_dir).select("cluster_id").distinct())


@_query(f"{_MEMBERS} SELECT cluster_id, id, CAST(k AS INT) AS place FROM members WHERE k <= 2")
def q_cluster_top2(spark, sf_dir):
    rows = ranking.top_each(_members(spark, sf_dir), "cluster_id", [F.col("sharpness").desc(), F.col("id")], 2)
    return rows.select("cluster_id", "id", F.col("rank_in_group").alias("place"))


@_query(f"{_CLUSTERS} SELECT CAST(sum(n - 1) AS BIGINT) AS merged FROM (SELECT count(*) AS n FROM found GROUP BY cluster_id)")
def q_merged_count(spark, sf_dir):
    return _clusters(spark, sf_dir).groupBy("cluster_id").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("merged"))


def _stretch_sql(column: str, valid: str, floor: str) -> str:
    return f"""WITH {_SCORED}, ranked AS (SELECT {column} AS v, row_number() OVER (ORDER BY {column}) AS k, count(*) OVER () AS n FROM scored WHERE {valid}
    ), b AS (SELECT max(v) FILTER (WHERE k = 1 + greatest(0, CAST(floor(n * 0.05::DOUBLE) AS BIGINT) - 1)) AS lo, max(v) FILTER (WHERE k = 1 + least(n - 1, CAST(floor(n * 0.95::DOUBLE) AS BIGINT) - 1)) AS hi FROM ranked)
    SELECT id, CASE WHEN {valid} AND hi - lo >= 0.5 THEN round(greatest(greatest(0, least(1, ({column} - lo) / (hi - lo))), {floor}) * 10, 4) ELSE {column} END AS {column} FROM scored, b"""


@_query(_stretch_sql("topiq", "topiq > 0", "0"))
def q_batch_stretch(spark, sf_dir):
    return ranking.stretch(tables.scored(spark, sf_dir).select("id", "topiq"), "topiq", F.col("topiq") > 0)


@_query(_stretch_sql("vlm", "vlm > 0", "0.01"))
def q_vlm_stretch_floor(spark, sf_dir):
    return ranking.stretch(tables.scored(spark, sf_dir).select("id", "vlm"), "vlm", F.col("vlm") > 0, 0.01)


@_query(f"""WITH {_SCORED}, t AS (SELECT *, CASE WHEN face_ratio < 0.1 THEN '人脸较小，不作清晰度评判' WHEN clarity >= 0.15 THEN '清晰' WHEN clarity >= 0.1 THEN '轻微模糊' ELSE '明显模糊' END AS c,
  CASE WHEN face_ratio >= 0.3 THEN '特写' WHEN face_ratio >= 0.1 THEN '半身' ELSE '环境人像' END AS s, CASE WHEN second_ratio >= 0.7 THEN '均匀' WHEN second_ratio < 0.5 THEN '主次分明' ELSE '大小略有差异' END AS d,
  CASE WHEN main_blink THEN '是' ELSE '否' END AS m, CASE WHEN any_blink THEN '是' ELSE '否' END AS a FROM scored)
  SELECT id, CASE WHEN face_count = 0 THEN '【人脸检测信息】未检测到人脸，请聚焦场景本身。'
    WHEN face_count = 1 THEN '【人脸检测信息】检测到 1 张人脸；主脸闭眼：' || m || '；主脸清晰度：' || c || '；人脸占比：' || s || '。'
    WHEN face_count <= 9 AND d = '主次分明' THEN '【人脸检测信息】检测到 ' || face_count || ' 张人脸，主次分明（疑似单主体+背景人群）；主脸闭眼：' || m || '；主脸清晰度：' || c || '；主脸占比：' || s || '。'
    WHEN face_count <= 9 THEN '【人脸检测信息】检测到 ' || face_count || ' 张人脸，' || CASE d WHEN '均匀' THEN '面积均匀分布' ELSE d END || '（疑似合影）；存在闭眼者：' || a || '；主脸清晰度：' || c || '；人脸占比：' || s || '。'
    WHEN d = '主次分明' THEN '【人脸检测信息】检测到 ' || face_count || ' 张人脸（多人场景，主次分明，疑似单主体+环境人群）；主脸闭眼：' || m || '；主脸清晰度：' || c || '；主脸占比：' || s || '。'
    ELSE '【人脸检测信息】检测到 ' || face_count || ' 张人脸（多人场景，' || CASE d WHEN '均匀' THEN '面积均匀' ELSE d END || '，疑似合影）；存在闭眼者：' || a || '；人脸占比：' || s || '。' END AS summary FROM t""")
def q_face_bins(spark, sf_dir):
    names_ = ("face_count", "face_ratio", "second_ratio", "clarity", "main_blink", "any_blink")
    return tables.scored(spark, sf_dir).select("id", scores.face_summary(*map(F.col, names_)).alias("summary"))


@_query("""WITH f AS (SELECT vec_id AS id, unnest(range(least(vec_id % 4, 3))) AS j FROM embeddings),
  c AS (SELECT *, id * 7 % 50 / 100::DOUBLE + j * 0.05::DOUBLE AS x, id * 5 % 50 / 100::DOUBLE AS y FROM f),
  b AS (SELECT *, (CAST(floor((x + 0.1::DOUBLE + id * (j + 3) % 20 / 100::DOUBLE) * 1024) AS BIGINT) - CAST(floor(x * 1024) AS BIGINT))
    * (CAST(floor((y + 0.2::DOUBLE + id * (j + 1) % 15 / 100::DOUBLE) * 1024) AS BIGINT) - CAST(floor(y * 1024) AS BIGINT)) AS area,
    id * (j + 11) % 10 / 10::DOUBLE > 0.5::DOUBLE AS blink, id * (j + 13) % 8 / 16::DOUBLE AS smile FROM c),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY area DESC, j) AS k FROM b),
  m AS (SELECT id, CAST(count(*) AS INT) AS n, bool_or(blink) AS one_blinks, bool_or(blink AND k = 1) AS first_blinks, max(smile) AS smile, max(area) FILTER (WHERE k = 1) AS a, max(area) FILTER (WHERE k = 2) AS a2 FROM r GROUP BY id)
  SELECT vec_id AS id, coalesce(n, 0) AS face_count, coalesce(one_blinks, false) AS any_blink, coalesce(first_blinks, false) AS main_blink, coalesce(smile, 0) AS smile,
    coalesce(round(a / 1048576::DOUBLE, 4), 0) AS ratio, coalesce(round(a2 / a::DOUBLE, 4), 0) AS second_ratio FROM embeddings LEFT JOIN m ON m.id = vec_id""")
def q_face_geometry(spark, sf_dir):
    rows = tables.detections(spark, sf_dir).select("id", faces.metrics(F.col("faces"), F.lit(1024), F.lit(1024)).alias("m"))
    return rows.select("id", *[F.col("m")[k].alias(k) for k in ("face_count", "any_blink", "main_blink", "smile", "ratio", "second_ratio")])


_PROMPT = prompts.TASK.replace("{FLAWS}", " / ".join(prompts.FLAWS)).replace("{CATEGORIES}", " / ".join(prompts.CATEGORIES))


@_query(f"""SELECT event_id, md5('{prompts.HEAD}' || CASE WHEN event_id % 3 = 0 THEN replace('{prompts.FACES}', '{{FACES}}', 'faces: ' || event_id) ELSE '{prompts.PLAIN.replace("'", "''")}' END || '{_PROMPT}') AS prompt FROM events""")
def q_prompt(spark, sf_dir):
    i = F.col("event_id")
    summary = F.when(i % 3 == 0, F.concat(F.lit("faces: "), i.cast("string"))).when(i % 3 == 1, prompts.NO_FACE)
    return table(spark, sf_dir, "events").select("event_id", F.md5(prompts.prompt(summary)).alias("prompt"))


@_query(f"WITH {_SCORED} SELECT id, main_blink OR (face_count > 0 AND face_ratio > 0.1 AND clarity < 0.1) AS flagged FROM scored")
def q_face_hard_flag(spark, sf_dir):
    return tables.scored(spark, sf_dir).select("id", scores.face_flag(F.col("face_count") > 0, F.col("face_ratio"), F.col("clarity"), F.col("main_blink")).alias("flagged"))


@_query(f"WITH {_SCORED} SELECT id, round(CASE WHEN face_count >= 6 AND face_ratio < 0.1 THEN 0 ELSE clarity * 0.5::DOUBLE + face * 0.3::DOUBLE + CASE WHEN main_blink THEN 0 ELSE 0.2::DOUBLE END END, 6) AS face_score FROM scored")
def q_env_face_override(spark, sf_dir):
    overall = scores.face_overall(F.col("clarity"), F.col("face"), F.col("main_blink"))
    return tables.scored(spark, sf_dir).select("id", F.round(scores.face_score(F.col("face_count"), F.col("face_ratio"), overall), 6).alias("face_score"))


_CLAMP = "CASE WHEN o IS NOT NULL THEN round(greatest(1, least(10, CAST(o ->> '$.{0}' AS DOUBLE))), 1) END"


def _rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.replies(spark, sf_dir).select("event_id", scores.rubric(F.col("reply")).alias("r"))


@_query(f"WITH {_REPLIES} SELECT event_id, {', '.join(_CLAMP.format(s) + ' AS ' + s for s in scores.SCORES)}, trim(o ->> '$.reason')[:200] AS reason FROM objects")
def q_rubric_parse(spark, sf_dir):
    return _rubric(spark, sf_dir).select("event_id", *[F.col("r")[s].alias(s) for s in scores.SCORES], F.col("r")["reason"].alias("reason"))


@_query(f"WITH {_REPLIES} SELECT event_id, CASE WHEN o IS NULL THEN NULL WHEN o ->> '$.hard_flaws' IS NULL THEN '' ELSE CASE event_id % 6 WHEN 0 THEN '模糊,闭眼' ELSE '过曝' END END AS flaws FROM objects")
def q_flaw_whitelist(spark, sf_dir):
    return _rubric(spark, sf_dir).select("event_id", F.array_join(F.col("r")["hard_flaws"], ",").alias("flaws"))


@_query(f"WITH {_REPLIES} SELECT event_id, CASE o ->> '$.category' WHEN '人文' THEN '人文纪实' WHEN '风景' THEN '风景' WHEN '宠物' THEN '动物' END AS category FROM objects")
def q_category_alias(spark, sf_dir):
    return _rubric(spark, sf_dir).select("event_id", F.col("r")["category"].alias("category"))


@_query(f"WITH {_REPLIES} SELECT event_id, CASE WHEN o IS NOT NULL THEN CASE WHEN event_id % 6 = 0 OR event_id % 4 = 0 THEN least(v, 6) ELSE v END END AS score FROM (SELECT *, {_CLAMP.format('overall_aesthetic_score')} AS v FROM objects)")
def q_flaw_clamp(spark, sf_dir):
    r = F.col("r")
    return _rubric(spark, sf_dir).select("event_id", F.when(r.isNotNull(), scores.clamped(r["overall_aesthetic_score"], F.col("event_id") % 4 == 0, r["hard_flaws"])).alias("score"))


_APPLIED = f"""applied AS (
  SELECT event_id, event_id % 10 <> 9 AS fine, o, event_id % 10 <> 9 AND o IS NOT NULL AS given, event_id % 4 = 0 OR event_id % 6 = 0 AS hit,
         {", ".join(f"CASE WHEN o IS NULL THEN 5.0 ELSE {_CLAMP.format(s)} END AS {s}" for s in scores.SCORES)} FROM objects)"""


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, none = F.col("event_id"), F.lit(None).cast("string")
    rows = _rubric(spark, sf_dir).withColumns({"flagged": i % 4 == 0, "error": F.when(i % 10 == 9, "failed"), "vlm": F.lit(3.0), "reason": F.lit("old"), "category": none, "hard_flaws": F.array().cast("array<string>")})
    return boards.rubric_applied(rows)


@_query(f"""WITH {_REPLIES}, {_APPLIED} SELECT event_id, CASE WHEN fine THEN composition_score END AS composition, CASE WHEN fine THEN color_score END AS color, CASE WHEN fine THEN lighting_score END AS lighting,
  CASE WHEN given THEN CASE WHEN hit THEN least(overall_aesthetic_score, 6) ELSE overall_aesthetic_score END ELSE 3.0::DOUBLE END AS vlm,
  CASE WHEN NOT given THEN 'old' WHEN NOT hit THEN coalesce(trim(o ->> '$.reason'), '') WHEN o ->> '$.reason' IS NULL THEN '{config.FLAW_SUFFIX.strip("（）")}' ELSE trim(o ->> '$.reason') || '{config.FLAW_SUFFIX}' END AS reason,
  CASE WHEN given THEN CASE event_id % 6 WHEN 0 THEN '人文纪实' WHEN 1 THEN '风景' WHEN 5 THEN '动物' END END AS category,
  CASE WHEN NOT given THEN '' ELSE CASE event_id % 6 WHEN 0 THEN '模糊,闭眼' WHEN 5 THEN '过曝' ELSE '' END END AS flaws FROM applied""")
def q_rubric_applied(spark, sf_dir):
    columns = ("composition", "color", "lighting", "vlm", "reason", "category")
    return _applied(spark, sf_dir).select("event_id", *columns, F.array_join("hard_flaws", ",").alias("flaws"))


@_query(f"WITH {_REPLIES} SELECT event_id AS id, {_CLAMP.format('composition_score')} AS composition FROM objects WHERE event_id % 10 <> 9 AND event_id % 3 <> 0")
def q_replies_merged(spark, sf_dir):
    rows = tables.replies(spark, sf_dir).withColumnRenamed("event_id", "id")
    items = rows.select("id", F.when(F.col("id") % 10 == 9, "failed").alias("error"))
    return boards.replies_merged(items, rows.where("id % 3 <> 0")).select("id", F.col("r")["composition_score"].alias("composition"))


@_query(f"""WITH {_SCORED} SELECT id, CASE WHEN id % 3 = 0 THEN 0 WHEN face_count >= 6 AND face_ratio < 0.1 THEN 0 ELSE round(clarity * 0.5::DOUBLE + 0.2::DOUBLE, 6) END AS face,
  CASE WHEN id % 5 = 0 THEN 0.5 ELSE round(objective, 6) END AS objective, id % 7 <> 0 AS printed FROM scored""")
def q_board_lookups(spark, sf_dir):
    rows = tables.scored(spark, sf_dir)
    found = rows.where("id % 3 <> 0").select("id", "face_count", F.col("face_ratio").alias("ratio"), (F.col("clarity") * 0.5 + 0.2).alias("face_overall"))
    measures = rows.where("id % 5 <> 0").select("id", F.col("objective").alias("overall"))
    out = boards.looked_up(rows.select("id"), found, measures, rows.where("id % 7 <> 0").select("id", "h"))
    return out.select("id", *_six("face", "objective"), F.col("h").isNotNull().alias("printed"))


@_query(_stretch_sql("vlm", "vlm > 0", "0.01").replace("SELECT id, CASE", "SELECT id, vlm > 6 AND main_blink AS noted, CASE WHEN main_blink THEN least(vlm, 6) ELSE vlm END AS vlm FROM (SELECT id, main_blink, CASE") + ")")
def q_vlm_settled(spark, sf_dir):
    rows = tables.scored(spark, sf_dir).select("id", "vlm", F.col("main_blink").alias("flagged"), F.lit("").alias("reason"), F.array().cast("array<string>").alias("hard_flaws"))
    return boards.vlm_settled(rows).select("id", (F.col("reason") != "").alias("noted"), "vlm")


@_query("""SELECT has_face, has_vlm, round(CASE WHEN f THEN 0.45 ELSE 0.45::DOUBLE / 0.85 END, 6) AS vlm, round(CASE WHEN f THEN 0.3 ELSE 0.3::DOUBLE / 0.85 END, 6) AS topiq,
  round(CASE WHEN f THEN 0.15 ELSE 0::DOUBLE END, 6) AS face, round(CASE WHEN f THEN 0.1 ELSE 0.1::DOUBLE / 0.85 END, 6) AS objective
  FROM (SELECT *, has_face AND NOT has_vlm AS f FROM (SELECT DISTINCT o_orderkey % 2 = 0 AS has_face, o_custkey % 2 = 0 AS has_vlm FROM orders))""")
def q_effective_weights(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 2 == 0).alias("has_face"), (F.col("o_custkey") % 2 == 0).alias("has_vlm")).distinct()
    return rows.select("has_face", "has_vlm", *[F.round(w, 6).alias(k) for k, w in scores.weights(F.col("has_face"), F.col("has_vlm")).items()])


@_query("WITH " + _SCORED + ", w(platform, a, b, c) AS (VALUES " + ", ".join(f"('{p}', {w['composition']}::DOUBLE, {w['color']}::DOUBLE, {w['lighting']}::DOUBLE)" for p, w in PLATFORMS.items()) + ") SELECT id, platform, round((composition * a + color * b + lighting * c) / (a + b + c), 6) AS dims FROM scored, w")
def q_dim_score_platform(spark, sf_dir):
    kinds = F.array(*[F.struct(F.lit(p).alias("platform"), *[F.lit(x).alias(f"w_{k}") for k, x in w.items()]) for p, w in PLATFORMS.items()])
    rows = tables.scored(spark, sf_dir).select("id", "topiq", "composition", "color", "lighting", F.inline(kinds))
    value = scores.platform_score({k: F.col(k) for k in ("composition", "color", "lighting")}, {k: F.col(f"w_{k}") for k in ("composition", "color", "lighting")}, F.col("topiq"))
    return rows.select("id", "platform", F.round(value, 6).alias("dims"))


@_query(f"WITH {_SCORED} SELECT id, round(score, 6) AS final FROM final")
def q_fusion(spark, sf_dir):
    return boards.fused(tables.scored(spark, sf_dir)).select("id", *_six("final"))


@_query(f"WITH {_SCORED} SELECT id, CASE WHEN has_vlm THEN round(abs(eff - topiq), 4) END AS divergence FROM fused")
def q_divergence(spark, sf_dir):
    return boards.fused(tables.scored(spark, sf_dir)).select("id", "divergence")


_DIVERSE = f"WITH {_SCORED}, {_BITS}, near AS (SELECT f.id, f.score, EXISTS (SELECT 1 FROM final g JOIN bits y ON y.id = g.id WHERE (g.topiq > f.topiq OR (g.topiq = f.topiq AND g.id < f.id)) AND hamming(x.h, y.h) < {NEAR_BITS + 1}) AS penalised FROM final f JOIN bits x ON x.id = f.id), lowered AS (SELECT id, penalised, CASE WHEN penalised THEN score * 0.85::DOUBLE ELSE score END AS final FROM near)"


@_query(f"{_DIVERSE} SELECT id, penalised, round(final, 6) AS final FROM lowered")
def q_diversity_penalty(spark, sf_dir):
    rows = boards.diverse(boards.fused(tables.scored(spark, sf_dir)), [F.col("topiq").desc(), F.col("id")], NEAR_BITS + 1)
    return rows.select("id", "penalised", *_six("final"))


@_query(f"{_DIVERSE} SELECT id, round(final, 6) AS final FROM lowered ORDER BY final DESC, id LIMIT 100")
def q_final_topn(spark, sf_dir):
    return boards.photo_board(tables.scored(spark, sf_dir), bits=NEAR_BITS + 1).select("id", *_six("final"))


@_query(f"""WITH {_FRAMES}, rated AS (SELECT *, 1 + video % 5 AS fps, count(*) OVER (PARTITION BY video) / (1 + video % 5)::DOUBLE AS secs FROM frames)
  SELECT video, seq, event_id, round_even((seq - 1) / fps::DOUBLE, 2) AS "timestamp", secs AS duration FROM rated
  WHERE (seq - 1) % greatest(1, CAST(round_even(CASE WHEN secs > 10 THEN secs / 10 ELSE 1 END * fps, 0) AS BIGINT)) = 0""")
def q_frame_sample(spark, sf_dir):
    rows = tables.frames(spark, sf_dir)
    counts = rows.groupBy("video").agg(F.count("*").alias("frame_count"))
    rows = rows.join(counts, "video").withColumns({"idx": F.col("seq") - 1, "fps": (1 + F.col("video") % 5).cast("double")})
    return frame_ops.sampled(rows, 1.0, 10).select("video", F.col("seq").cast("long").alias("seq"), "event_id", "timestamp", "duration")


def _exposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.frames(spark, sf_dir).withColumns({"over": F.col("event_id") % 50 == 0, "under": F.col("event_id") % 53 == 0})


@_query("SELECT event_id FROM events WHERE event_id % 50 <> 0 AND event_id % 53 <> 0 AND value >= 3 AND event_type <> 'error'")
def q_frames_kept(spark, sf_dir):
    return frame_ops.kept(_exposed(spark, sf_dir)).select("event_id")


@_query("SELECT event_id, value AS sharpness FROM events WHERE value >= 3.0")
def q_absolute_blur(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value >= 3.0").select("event_id", F.col("value").alias("sharpness"))


@_query(f"WITH {_FRAMES}, b AS (SELECT video, count(*) AS n, quantile_cont(sharpness, 0.3) AS p FROM frames GROUP BY video) SELECT event_id, n >= 4 AND sharpness < greatest(p, 3) AS blurry FROM frames JOIN b USING (video)")
def q_relative_blur(spark, sf_dir):
    return frame_ops.relative_blur(tables.frames(spark, sf_dir)).select("event_id", "blurry")


@_query(f"""WITH RECURSIVE {_FRAMES}, rated AS (SELECT *, count(*) OVER (PARTITION BY video) AS n FROM frames),
  samples AS (SELECT video, event_id, (row_number() OVER (PARTITION BY video ORDER BY seq) - 1) // 20 AS batch, h FROM (
    SELECT f.*, ('0x' || left(md5(e.props), 16))::UBIGINT AS h FROM rated f JOIN events e USING (event_id)
    WHERE (f.seq - 1) % greatest(1, CAST(round_even(CASE WHEN n > 200 THEN n / 200 ELSE 1 END, 0) AS BIGINT)) = 0)),
  batches AS (SELECT video, batch, list({{'id': event_id, 'h': h}}) AS some FROM samples GROUP BY video, batch),
  steps AS (
    SELECT video, -1::BIGINT AS batch, []::STRUCT(id BIGINT, h UBIGINT)[] AS kept FROM batches WHERE batch = 0
    UNION ALL
    SELECT b.video, b.batch, list_concat(s.kept, list_filter(b.some, lambda x: len(list_filter(s.kept, lambda k: bit_count(xor(k.h, x.h)) < {config.CLUSTER_BITS})) = 0))
    FROM steps s JOIN batches b ON b.video = s.video AND b.batch = s.batch + 1)
  SELECT video, unnest(kept).id AS event_id FROM steps s WHERE batch = (SELECT max(batch) FROM batches b WHERE b.video = s.video)""")
def q_frame_dedup(spark, sf_dir):
    rows = tables.frames(spark, sf_dir)
    counts = rows.groupBy("video").agg(F.count("*").alias("frame_count"))
    rows = frame_ops.sampled(rows.join(counts, "video").withColumns({"idx": F.col("seq") - 1, "fps": F.lit(1.0)})).select("video", "seq", "event_id", "h")
    return frame_ops.drop_repeats(rows).select("video", "event_id")


@_query("SELECT user_id AS video, count(*) AS n, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY user_id")
def q_video_percentile(spark, sf_dir):
    return ranking.percentiles(tables.frames(spark, sf_dir), "video", "sharpness", 0.9).select("video", "n", F.round("value", 6).alias("p90"))


@_query(f"WITH {_QUOTAS} SELECT video, quota FROM quotas")
def q_video_quota(spark, sf_dir):
    return ranking.quotas(tables.videos(spark, sf_dir), SLOTS).select("video", "quota")


_CAP = 8


@_query(_QUOTAS.replace(_FRAMES + ", ", "WITH " + _FRAMES + ", raw AS (SELECT video, duration, greatest(1, CAST(round_even(1000 * duration / (SELECT sum(duration) FROM videos), 0) AS BIGINT)) AS q FROM videos), ").replace(f"""given AS (
  SELECT video, duration, greatest(1, CAST(round_even({SLOTS} * duration / (SELECT sum(duration) FROM videos), 0) AS BIGINT)) AS q FROM videos
)""", f"given AS (SELECT video, duration, least(q, {_CAP}) AS q FROM raw)").split(", quotas AS")[0] + f""", more AS (
  SELECT video, greatest(0, least({_CAP} - q, {SLOTS} - (SELECT sum(q) FROM given) - (sum({_CAP} - q) OVER (ORDER BY duration DESC, video) - ({_CAP} - q)))) AS n FROM given WHERE q < {_CAP})
  SELECT g.video, CAST(g.q - coalesce(b.n, 0) + coalesce(m.n, 0) AS BIGINT) AS quota FROM given g LEFT JOIN back b USING (video) LEFT JOIN more m USING (video)""")
def q_quota_capped(spark, sf_dir):
    return ranking.quotas(tables.videos(spark, sf_dir), SLOTS, _CAP / SLOTS).select("video", "quota")


@_query(f"WITH {_QUOTAS} SELECT video, event_id, CAST(k AS INT) AS place FROM (SELECT f.video, event_id, quota, row_number() OVER (PARTITION BY f.video ORDER BY overall DESC, seq) AS k FROM frames f JOIN quotas q ON q.video = f.video) WHERE k <= quota")
def q_video_topk(spark, sf_dir):
    rows = boards.video_board(tables.frames(spark, sf_dir), tables.videos(spark, sf_dir), SLOTS)
    return rows.select("video", "event_id", F.col("rank_in_group").alias("place"))


@_query(f"WITH {_FRAMES}, t AS (SELECT *, event_id % 50 = 0 OR event_id % 53 = 0 AS bad FROM frames) SELECT video, count(*) AS candidates, count(*) FILTER (WHERE bad) AS failed, count(*) FILTER (WHERE NOT bad AND sharpness < 3) AS blurry, count(*) FILTER (WHERE NOT bad AND sharpness >= 3 AND blink) AS blink, count(*) FILTER (WHERE NOT bad AND sharpness >= 3 AND NOT blink) AS kept FROM t GROUP BY video")
def q_video_stats(spark, sf_dir):
    return frame_ops.statistics(_exposed(spark, sf_dir))


@_query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)")
def q_new_items(spark, sf_dir):
    items, known = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0")
    return merge.unseen(items.select(F.col("c_custkey").alias("id")), known.select(F.col("o_custkey").alias("id")))


@_query("SELECT user_id AS id, min(value) AS score FROM events WHERE event_type = 'view' GROUP BY user_id UNION ALL SELECT user_id, max(value) FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'view') GROUP BY user_id")
def q_merge_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    old = rows.where("event_type = 'view'").groupBy(F.col("user_id").alias("id")).agg(F.min("value").alias("score"))
    new = rows.where("event_type = 'error'").groupBy(F.col("user_id").alias("id")).agg(F.max("value").alias("score"))
    return merge.keep_old(old, new)


@_query("SELECT o.event_id AS id, CASE WHEN o.event_id % 3 <> 0 AND o.event_type = 'error' THEN o.value * 2 ELSE o.value END AS overall FROM events o")
def q_overwrite_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    old = rows.select(F.col("event_id").alias("id"), F.col("value").alias("overall"))
    new = rows.where("event_type = 'error'").select(F.col("event_id").alias("id"), (F.col("value") * 2).alias("overall"), F.when(F.col("event_id") % 3 == 0, "failed").alias("error"))
    return merge.overwrite(old, new, ["overall"])


@_query("""WITH asked AS (SELECT DISTINCT user_id AS id, ['l1', 'l2', 'l4', 'topiq', 'vlm'][event_id * 7 % 5 + 1] AS layer FROM events WHERE event_id % 3 = 0),
  after(layer, also) AS (VALUES ('l1', 'l1'), ('l1', 'l2'), ('l1', 'l4'), ('l1', 'topiq'), ('l1', 'vlm'), ('l2', 'l2'), ('l2', 'l4'), ('l2', 'topiq'), ('l2', 'vlm'), ('l4', 'l4'), ('l4', 'vlm'), ('topiq', 'topiq'), ('vlm', 'vlm'))
  SELECT DISTINCT id, also AS layer FROM asked JOIN after USING (layer)""")
def q_rerun_closure(spark, sf_dir):
    layer = F.get(F.array(*map(F.lit, ("l1", "l2", "l4", "topiq", "vlm"))), (F.col("event_id") * 7 % 5).cast("int"))
    return merge.rerun_closures(table(spark, sf_dir, "events").where("event_id % 3 = 0").select(F.col("user_id").alias("id"), layer.alias("layer")))


_NEW = "id % 3 = 0 AND id % 15 <> 0 AND topiq > 0"


@_query(_stretch_sql("topiq", _NEW, "0").replace("ELSE topiq END AS topiq", "WHEN id % 15 = 0 THEN 0 ELSE topiq END AS topiq"))
def q_stage_merged(spark, sf_dir):
    """An incremental run's stage: old scores as they are, new ones stretched among themselves, 0 where the model failed."""
    rows = tables.scored(spark, sf_dir).select("id", "topiq")
    new = rows.where("id % 3 = 0").select("id", F.when(F.col("id") % 15 != 0, F.col("topiq")).alias("topiq"), F.when(F.col("id") % 15 == 0, "failed").alias("error"))
    old = rows.where("id % 3 <> 0").withColumn("error", F.lit(None).cast("string"))
    return merge.keep_old(old, runs.stretched(new)).select("id", "topiq")


@_query(_stretch_sql("topiq", "id % 5 <> 0 AND topiq > 0", "0"))
def q_stage_rerun(spark, sf_dir):
    """A rerun of the scores alone: stretched anew, but a row that fails keeps its old score."""
    old = tables.scored(spark, sf_dir).select("id", "topiq")
    new = old.select("id", F.when(F.col("id") % 5 != 0, F.col("topiq")).alias("topiq"), F.when(F.col("id") % 5 == 0, "failed").alias("error"))
    return merge.overwrite(old, runs.stretched(new), ["topiq"])


@_query("SELECT DISTINCT md5(html)[:8] || '.jpg' AS name FROM pages")
def q_upload_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    return rows.select(names.by_content(F.col("html"), F.lit("picture.JPG")).alias("name")).distinct()


@_query("""SELECT DISTINCT md5(html)[:8] || CASE page_id % 4 WHEN 0 THEN '.jpg' ELSE '.heic' END AS name FROM pages WHERE page_id % 4 IN (0, 2) AND page_id % 5 <> 1 AND length(html) <= 3000""")
def q_uploads_accepted(spark, sf_dir):
    i = F.col("page_id")
    name = F.concat(F.lit("/in/p"), i.cast("string"), F.element_at(F.array(*map(F.lit, (".JPG", ".exe", ".heic", ""))), (i % 4 + 1).cast("int")))
    mime = F.element_at(F.array(*map(F.lit, ("image/png", "text/html", "application/octet-stream", "", "image/heic"))), (i % 5 + 1).cast("int"))
    size = F.when(F.length("html") <= 3000, F.lit(10)).otherwise(F.lit(config.PICTURE_BYTES + 1))
    return images.accepted(table(spark, sf_dir, "pages").select(name.alias("path"), size.alias("length"), F.encode("html", "utf-8").alias("content"), mime.alias("mime"))).select("name")


@_query("SELECT page_id, md5(url)[:16] AS key FROM pages")
def q_cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", names.cache_key(F.col("url")).alias("key"))


@_query("SELECT 'f' || o_orderkey || '.jpg' AS filename, o_totalprice AS sharpness FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 5)")
def q_manifest_existing(spark, sf_dir):
    name = lambda k: F.concat(F.lit("f"), F.col(k).cast("string"), F.lit(".jpg"))
    rows = table(spark, sf_dir, "orders").select(name("o_orderkey").alias("filename"), F.col("o_totalprice").alias("sharpness"))
    return manifests.existing(rows, table(spark, sf_dir, "lineitem").where("l_linenumber = 5").select(name("l_orderkey").alias("name")))


@_query(r"""SELECT page_id, CASE WHEN x = '' OR x = '..' THEN 'unnamed' ELSE x END AS name FROM (SELECT page_id, trim(regexp_replace(string_split(replace(url, '\', '/'), '/')[-1], '[:*?"<>|]', '_', 'g')) AS x FROM pages)""")
def q_safe_filename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", names.safe(F.col("url")).alias("name"))


@_query("SELECT o_orderkey AS id, '20' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS date_key FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 3 <> 0")
def q_date_key(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("/photos/IMG_20"), F.lpad((k % 1000000).cast("string"), 6, "0"), F.lit("_1.jpg"))).otherwise(F.concat(F.lit("/20240101_x/clip"), k.cast("string"), F.lit(".jpg")))
    return table(spark, sf_dir, "orders").select(k.alias("id"), names.date_key(names.base_name(name)).alias("date_key"))


@_query("SELECT o_custkey AS name, o_orderkey AS seq, o_totalprice AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def q_manifest_last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"))
    return merge.last_wins(rows, "name", "seq")


@_query("SELECT k AS rank, printf('%02d_', k) || o_orderkey AS name FROM (SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS k FROM orders) WHERE k <= 100")
def q_display_names(spark, sf_dir):
    top = table(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100)
    ranked = ranking.global_rank(top, [F.col("o_totalprice").desc(), F.col("o_orderkey")]).withColumn("rank", F.col("rank").cast("int"))
    return ranked.select("rank", names.display(F.col("rank"), F.col("o_orderkey").cast("string")).alias("name"))


@_query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_tumbling(spark, sf_dir):
    rows = arrivals.tumbling(table(spark, sf_dir, "events"))
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@_query("""WITH m AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
  SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def q_session_windows(spark, sf_dir):
    rows = arrivals.sessions(table(spark, sf_dir, "events"))
    return rows.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@_query("""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, max(value) AS highest FROM (
  SELECT *, unnest([time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE for k in range(4)]) AS w FROM events) GROUP BY ALL""")
def q_sliding_windows(spark, sf_dir):
    rows = arrivals.sliding(table(spark, sf_dir, "events"))
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "highest")


@_query("SELECT DISTINCT user_id, event_type, CAST(floor(value) AS BIGINT) AS level FROM events")
def q_distinct_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor("value").alias("level"), "ts")
    return arrivals.distinct(rows, ["user_id", "event_type", "level"]).select("user_id", "event_type", "level")


def _made_up(rows: DataFrame) -> tuple:
    """Faces, scores and a judge of frames, from their ids."""
    i = F.col("id")
    part = lambda k, n, d: (i * k % n) / float(d)

    def faces_(items: DataFrame) -> DataFrame:
        kinds = {"face_overall": F.when(i % 3 == 0, 0.0).otherwise(part(11, 101, 100)), "face_count": F.lit(1), "ratio": F.lit(0.2), "clarity": F.lit(0.3), "second_ratio": F.lit(0.0), "any_blink": i % 7 == 0, "main_blink": i % 7 == 0, "has_face": F.lit(True)}
        return items.select("id", *[v.alias(k) for k, v in kinds.items()])

    def score(items: DataFrame) -> DataFrame:
        return items.select("id", F.when(i % 11 != 0, 2 + part(37, 701, 100)).alias("topiq"), F.when(i % 11 == 0, "failed").alias("error"))

    def judge(asked: DataFrame) -> DataFrame:
        number = lambda k: F.round(1 + part(k, 91, 10), 1).cast("string")
        fields = [F.concat(F.lit(f'"{s}": '), number(k)) for s, k in zip(scores.SCORES, (7, 13, 29, 17))]
        return asked.where("id % 4 <> 0").select("id", F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")).alias("reply"))

    return faces_, score, judge


_VIDEO_RUN = _QUOTAS + f""", manifest AS (
  SELECT e.user_id AS video, 'f' || e.event_id || '.jpg' AS filename, value AS sharpness, value / 500 AS objective, ('0x' || left(md5(props), 16))::UBIGINT AS h,
         row_number() OVER (ORDER BY 'f' || e.event_id || '.jpg') AS id FROM events e
), links AS (SELECT x.id AS a, y.id AS b FROM manifest x JOIN manifest y ON x.id <> y.id AND bit_count(xor(x.h, y.h)) <= {config.CLUSTER_BITS}
), reach AS (SELECT id, id AS root FROM manifest UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id WHERE l.b > r.root
), found AS (SELECT id, min(root) AS cluster_id FROM reach GROUP BY id
), shown AS (SELECT m.*, id % 11 <> 0 AS fine, id % 11 <> 0 AND id % 7 = 0 AS flagged FROM manifest m JOIN (
    SELECT id, row_number() OVER (PARTITION BY cluster_id ORDER BY sharpness DESC, id) AS k FROM found JOIN manifest USING (id)) USING (id) WHERE k <= 2
), raw AS (SELECT *, CASE WHEN fine THEN 2 + (id * 37 % 701) / 100::DOUBLE ELSE 0 END AS t0, CASE WHEN NOT fine OR id % 4 = 0 THEN 0 WHEN flagged THEN least(6, 1 + (id * 17 % 91) / 10::DOUBLE) ELSE 1 + (id * 17 % 91) / 10::DOUBLE END AS v0 FROM shown
), places AS (SELECT *, row_number() OVER (PARTITION BY t0 > 0 ORDER BY t0) AS tk, count(*) FILTER (WHERE t0 > 0) OVER () AS tn, row_number() OVER (PARTITION BY v0 > 0 ORDER BY v0) AS vk, count(*) FILTER (WHERE v0 > 0) OVER () AS vn FROM raw
), ends AS (SELECT max(t0) FILTER (WHERE t0 > 0 AND tk = 1 + greatest(0, CAST(floor(tn * 0.05::DOUBLE) AS BIGINT) - 1)) AS tl, max(t0) FILTER (WHERE t0 > 0 AND tk = 1 + least(tn - 1, CAST(floor(tn * 0.95::DOUBLE) AS BIGINT) - 1)) AS th,
         max(v0) FILTER (WHERE v0 > 0 AND vk = 1 + greatest(0, CAST(floor(vn * 0.05::DOUBLE) AS BIGINT) - 1)) AS vl, max(v0) FILTER (WHERE v0 > 0 AND vk = 1 + least(vn - 1, CAST(floor(vn * 0.95::DOUBLE) AS BIGINT) - 1)) AS vh FROM places
), levels AS (SELECT p.*, CASE WHEN t0 > 0 AND th - tl >= 0.5 THEN round(greatest(0, least(1, (t0 - tl) / (th - tl))) * 10, 4) ELSE t0 END AS topiq,
         CASE WHEN v0 > 0 AND vh - vl >= 0.5 THEN round(greatest(greatest(0, least(1, (v0 - vl) / (vh - vl))), 0.01) * 10, 4) ELSE v0 END AS v1 FROM places p, ends
), judged AS (SELECT *, CASE WHEN flagged THEN least(v1, 6) ELSE v1 END AS vlm, CASE WHEN id % 3 = 0 THEN 0 ELSE (id * 11 % 101) / 100::DOUBLE END AS face,
         CASE WHEN id % 4 = 0 THEN 5 ELSE ((1 + (id * 7 % 91) / 10::DOUBLE) * 0.35::DOUBLE + (1 + (id * 13 % 91) / 10::DOUBLE) * 0.30::DOUBLE + (1 + (id * 29 % 91) / 10::DOUBLE) * 0.20::DOUBLE) / 0.85::DOUBLE END AS dims FROM levels
), parts AS (SELECT *, vlm > 0 AS has_vlm, face > 0 AND NOT vlm > 0 AS f FROM judged
), fused AS (SELECT *, CASE WHEN f THEN 0.45::DOUBLE ELSE 0.45::DOUBLE / 0.85 END * CASE WHEN has_vlm THEN dims * 0.7::DOUBLE + vlm * 0.3::DOUBLE ELSE topiq END + CASE WHEN f THEN 0.30::DOUBLE ELSE 0.30::DOUBLE / 0.85 END * topiq
         + CASE WHEN f THEN 0.15::DOUBLE ELSE 0 END * 10 * face + CASE WHEN f THEN 0.10::DOUBLE ELSE 0.10::DOUBLE / 0.85 END * 10 * objective AS score FROM parts
), final AS (SELECT x.*, score * CASE WHEN EXISTS (SELECT 1 FROM fused y WHERE (y.topiq > x.topiq OR (y.topiq = x.topiq AND y.id < x.id)) AND bit_count(xor(x.h, y.h)) < {NEAR_BITS - 1}) THEN 0.85::DOUBLE ELSE 1 END AS final FROM fused x)"""


@_query(f"""WITH RECURSIVE {_VIDEO_RUN} SELECT filename, round(topiq, 4) AS topiq, round(vlm, 4) AS vlm, round(final, 4) AS final FROM (
  SELECT f.*, quota, row_number() OVER (PARTITION BY f.video ORDER BY final DESC, topiq DESC, id) AS k FROM final f JOIN quotas q ON q.video = f.video) WHERE k <= quota""")
def q_video_run(spark, sf_dir):
    """The whole video board: clusters of all frames, faces, scores, a judge, their stretch, the fusion, the penalty and the slots."""
    rows = table(spark, sf_dir, "events").join(tables.videos(spark, sf_dir).withColumnRenamed("video", "user_id"), "user_id")
    name = F.concat(F.lit("f"), F.col("event_id").cast("string"), F.lit(".jpg"))
    manifest = rows.select(name.alias("filename"), F.col("user_id").alias("source_video"), F.lit(0.0).alias("timestamp"), F.col("value").alias("sharpness"), (F.col("value") / 500).alias("overall"), F.substring(F.md5("props"), 1, 16).alias("phash"), "duration")
    faces_, score, judge = _made_up(manifest)
    board = runs.Videos(faces=faces_, score=score, judge=judge).run(manifest, slots=SLOTS, near=NEAR_BITS - 1)
    return board.select("filename", "topiq", "vlm", F.round("final", 4).alias("final"))
