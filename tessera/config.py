"""Fixed values of the curation rules: thresholds, weights and names that results depend on."""

# Objective quality: a picture is blurry below, over- or underexposed above these.
SHARPNESS_MIN = 70.0
BRIGHT, BRIGHT_SHARE = 240, 0.4
DARK, DARK_SHARE = 15, 0.8
EXPOSURE_BAND = (70.0, 180.0)

# Near duplicates: bits at most within a cluster; diversity: bits below which a later item is penalised.
CLUSTER_BITS = 16
DIVERSITY_BITS, DIVERSITY_PENALTY = 10, 0.15

# White space that is stripped from replies: that of Unicode and the four separators (fixed values).
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# Uploads: types of files and of content, bytes at most.
PICTURE_TYPES = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "heic", "heif")
VIDEO_TYPES = ("mp4", "mov", "avi", "mkv", "webm", "m4v")
ANY_CONTENT = "application/octet-stream"
PICTURE_BYTES, VIDEO_BYTES = 50 * 1024 * 1024, 200 * 1024 * 1024

# Boards.
TOP_N, VIDEO_SLOTS = 100, 20
FRAME_INTERVAL, FRAMES_MOST = 1.0, 200
FRAME_SHARPNESS_MIN, FRAME_BLUR_SHARE, FRAME_BATCH = 3.0, 0.3, 20

# Weights of the fused score, and of the dimensions by platform.
FUSION = {"vlm": 0.45, "topiq": 0.30, "face": 0.15, "objective": 0.10}
PLATFORMS = {
    "xiaohongshu": {"composition": 0.35, "color": 0.30, "lighting": 0.20},
    "wechat": {"composition": 0.25, "color": 0.25, "lighting": 0.30},
    "douyin": {"composition": 0.30, "color": 0.25, "lighting": 0.25},
}

# Names (fixed values): reasons of rejection, categories with their synonyms, flaws.
BLURRY, OVER, UNDER, UNREADABLE = "模糊", "过曝", "欠曝", "无法读取图片"
CATEGORIES = ["风景", "建筑", "人像", "人文纪实", "美食", "动物", "夜景", "其他"]
CATEGORY_ALIASES = {
    "人文": "人文纪实", "纪实": "人文纪实", "街头": "人文纪实", "街头人文": "人文纪实", "人物": "人像", "夜景人像": "人像",
    "环境人像": "人像", "风光": "风景", "自然风光": "风景", "宠物": "动物", "野生动物": "动物", "食物": "美食", "夜色": "夜景",
}
FLAWS = ["模糊", "过曝", "欠曝", "噪点明显", "歪斜", "画面杂乱", "主体裁切", "逆光发黑", "地平线穿头", "闭眼", "人脸模糊"]
DEFAULT_DIM, FLAWED_MOST = 5.0, 6.0
EYES_CLOSED = "闭眼"
CLAMP_NOTE = "已钳制至 6 分上限"
FLAW_SUFFIX = "（人像硬伤：闭眼/主脸模糊，已钳制至 6 分上限）"

# Descriptions of faces (fixed values), as they go into the rubric's prompt: without a face, with one, with 2 to 9, with more;
# where one face is apart, where sizes differ a little, where they are even. And the words that are put into them.
FACES_NONE = "【人脸检测信息】未检测到人脸，请聚焦场景本身。"
FACES_ONE = "【人脸检测信息】检测到 {count} 张人脸；主脸闭眼：{main}；主脸清晰度：{clear}；人脸占比：{size}。"
FACES_FEW_APART = "【人脸检测信息】检测到 {count} 张人脸，主次分明（疑似单主体+背景人群）；主脸闭眼：{main}；主脸清晰度：{clear}；主脸占比：{size}。"
FACES_FEW_UNLIKE = "【人脸检测信息】检测到 {count} 张人脸，大小略有差异（疑似合影）；存在闭眼者：{some}；主脸清晰度：{clear}；人脸占比：{size}。"
FACES_FEW_EVEN = "【人脸检测信息】检测到 {count} 张人脸，面积均匀分布（疑似合影）；存在闭眼者：{some}；主脸清晰度：{clear}；人脸占比：{size}。"
FACES_MANY_APART = "【人脸检测信息】检测到 {count} 张人脸（多人场景，主次分明，疑似单主体+环境人群）；主脸闭眼：{main}；主脸清晰度：{clear}；主脸占比：{size}。"
FACES_MANY_UNLIKE = "【人脸检测信息】检测到 {count} 张人脸（多人场景，大小略有差异，疑似合影）；存在闭眼者：{some}；人脸占比：{size}。"
FACES_MANY_EVEN = "【人脸检测信息】检测到 {count} 张人脸（多人场景，面积均匀，疑似合影）；存在闭眼者：{some}；人脸占比：{size}。"
FACE_SIZES = ("特写", "半身", "环境人像")
FACE_CLEAR = ("清晰", "轻微模糊", "明显模糊", "人脸较小，不作清晰度评判")
YES, NO = "是", "否"

# Rerun of a layer also reruns these.
DOWNSTREAM = {"l1": ("l2", "l4", "topiq", "vlm"), "l2": ("l4", "topiq", "vlm"), "l4": ("vlm",)}
