"""Where a picture or film came from, scored by signals: media of apps, forwarded media and screenshots.

Every classifier is one pass of column expressions over a catalogue row, so it runs inside generated code and needs no shuffle. A rule
list is tried in its order and the first that fits names the app; other signals add their points.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.operators.classify import fits, screenshot_category
from shutterlake.operators.once import made_once
from shutterlake.sources.media import media_type

KB = 1024
#: Sizes to which platforms resize what is sent or posted.
PLATFORM_SIZES = (
    (1600, 1600), (1600, 900), (1280, 1280), (720, 1600), (720, 1280), (1080, 1080), (1080, 1350),
    (1080, 1920), (1080, 608), (1200, 630), (960, 960), (848, 480), (640, 480), (512, 512),
)
#: Display sizes that count for the screenshot score.
DISPLAY_SIZES = (
    (1080, 1920), (1080, 2340), (1080, 2400), (1080, 2460), (1170, 2532), (1179, 2556), (1284, 2778), (1290, 2796), (1320, 2868), (1440, 3120),
    (1440, 3200), (1620, 2160), (2048, 2732), (1640, 2360), (1668, 2388), (1600, 2560), (1366, 768), (1440, 900), (1600, 900), (1680, 1050),
    (1920, 1080), (1920, 1200), (2560, 1440), (2560, 1600), (3024, 1964), (3440, 1440), (3840, 2160), (5120, 2880),
)
#: Patterns of lower-case file names.
WHATSAPP_NAME = r"^(img|vid|stk)-\d{8}-wa\d{4,}\."
WHATSAPP_EXPORT = r"whatsapp (image|video|audio|document) \d{4}-\d{2}-\d{2}"
WHATSAPP_PREFIX = r"^wa[-_]?\d+"
WHATSAPP_CODE = r"^[a-z]{4,7}\d{4,5}\.(jpg|jpeg|mov|mp4|png|webp)$"
INSTAGRAM_HASH = r"^\d{6,15}_\d{10,25}_\d{10,25}_[no]\.(jpg|mp4|webp)$"
INSTAGRAM_PREFIX = r"^(instagram|ig|reels)[-_]"
LINKEDIN = r"^linkedin-feed-image-|^feedshare-shrink_|^li_feed_|\blinkedin\b"
EDITOR = r"canva\s*-\s*|untitled\s*design|^canva_|^snapseed|^vsco|^inshot|^capcut|^picsart|_edit\b|_edited\b|_psd\b|_export\b|_render\b|adobe|photoshop|lightroom"
EDITOR_FOLDERS = ("/snapseed/", "/vsco/", "/inshot/", "/capcut/", "/picsart/")
DOWNLOAD = (
    r"^download(\s*\(\d+\))?\.(jpg|jpeg|png|webp|gif|mp4|mov)$|^image(\s*\(\d+\))?\.(jpg|jpeg|png|webp)$|^photo(\s*\(\d+\))?\.(jpg|jpeg|png)$"
    r"|^untitled(\s*\(\d+\))?\.(jpg|jpeg|png|webp)$|^save_image|^(chrome|safari|firefox|edge)[-_]"
    r"|favicon|logo|banner|header|button|badge|clipart|vector|stockphoto|infographic|artboard"
)
DOWNLOAD_FOLDER = r"/downloads/[^/]+\.[a-z0-9]+$|/browser/[^/]+\.[a-z0-9]+$|/chrome/downloads|/safari/downloads"
ANY_DOWNLOAD = r"^(download|image|photo|untitled)(\s*\(\d+\))?\.|^save_image|favicon|logo|icon|clipart|vector|stock|graphic|asset|badge|button|infographic"
TELEGRAM = r"^photo_\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}\."
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\."
CAMERA_ROLL = r"^img_e?\d{4}\.(heic|dng|jpg|jpeg|mov|mp4|png)$"
QUOTES = "funny|joke|quote|good morning|happy|blessed|life|truth|daily|follow|share|subscribe"
EXACT_SHOT = r"^screenshot[ _-]\d{4}-\d{2}-\d{2}[ _-]\d{6}|^screen ?shot \d{4}-\d{2}-\d{2} at \d{1,2}\.\d{2}\.\d{2}|^screenshot_\d{8}[-_]\d{6}"
SHOT_WORD = r"\b(screenshot|screen[ _]shot)\b|(^|[\s_\-.])screen[\s_]?shot($|[\s_\-.])"
SHOT_TOOLS = "screencapture|snipping tool|screenshot|greenshot|sharex|lightshot|com.apple.nsscreenshot"

APPS = ("whatsapp", "instagram", "snapchat", "linkedin", "browser", "editor", "other-social", "other-apps")


class _Row:
    """The columns that signals look at; those that a frame lacks are null. They are made once a row, in ``df``, under names that ``plain`` takes away again."""

    def __init__(self, df: DataFrame, typed: bool = True):
        has = lambda c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
        said = lambda c: F.coalesce(F.trim(has(c, "string")) != "", F.lit(False))
        path = F.lower(F.regexp_replace(F.coalesce("file_path", F.lit("")), r"\\", "/"))
        w, h = (F.coalesce(F.col(c), F.lit(0)) for c in ("width", "height"))
        own = {
            "name": F.lower(F.trim(F.coalesce("filename", F.lit("")))), "path": path, "w": w, "h": h, "size": F.coalesce(F.col("file_size"), F.lit(0)), "camera": said("make") | said("model"),
            "film_camera": said("video_make") | said("video_model"), "text": F.lower(F.coalesce(has("extracted_text", "string"), F.lit(""))), "software": F.lower(F.coalesce(has("software", "string"), F.lit(""))),
        }
        if typed:
            own["kind"] = media_type(F.col("file_path"))["kind"]
        self.df = made_once(df, **{f"_of_{k}": v for k, v in own.items()})
        at = lambda k: F.col(f"_of_{k}")
        self.name, self.path, self.w, self.h, self.size, self.camera, self.film_camera, self.text, self.software = map(at, list(own)[:9])
        self.ext = F.substring_index(self.name, ".", -1)
        self.gps_lat, self.gps_lon = has("gps_lat", "double"), has("gps_lon", "double")
        self.any_exif = F.coalesce(has("has_exif", "boolean"), F.lit(False))
        self.exif = [F.coalesce(has(c, "double"), F.lit(0.0)) != 0 for c in ("f_number", "iso")] + [has("exposure_time", "string").isNotNull()]
        self.native_flag, self.unread = (F.coalesce(has(c, "boolean"), F.lit(False)) for c in ("os_native", "metadata_failed"))
        self.rate, self.film_w, self.film_h = (F.coalesce(has(c, "double"), F.lit(0.0)) for c in ("bit_rate", "video_width", "video_height"))
        self.sized = (self.w > 0) & (self.h > 0)
        self.longer, self.shorter = F.greatest(self.w, self.h), F.least(self.w, self.h)
        self.picture, self.film = (F.coalesce(at("kind").isin(*k), F.lit(False)) if typed else None for k in (("photo", "raw"), ("video", "cinema")))
        self.made = [f"_of_{k}" for k in own]

    def once(self, **columns: Column) -> list[Column]:
        """Further columns of ``df``, made once from those that it has."""
        self.df = made_once(self.df, **{f"_of_{k}": v for k, v in columns.items()})
        self.made += [f"_of_{k}" for k in columns]
        return [F.col(f"_of_{k}") for k in columns]

    def plain(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.made)

    def within(self, *folders: str) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(self.path, F.lit(x)) for x in folders])


def _first(rules: Sequence[tuple[str, int, Column]]) -> Column:
    """``struct(category, points)`` of the first rule that holds; null if none does."""
    cases = [F.when(cond, F.struct(F.lit(category).alias("category"), F.lit(points).alias("points"))) for category, points, cond in rules]
    return F.coalesce(*cases)


def _sum(signals: Sequence[tuple[int, Column]]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(cond, points).otherwise(0) for points, cond in signals])


def _bounded(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def app_media(photos: DataFrame) -> DataFrame:
    """``photos`` with ``app_category``, ``app_score`` (0 to 100) and ``app_class``: app-media from 60, uncertain from 35, else keep.

    Screenshots are kept with score 0, as they have a view of their own. Looks at filename, file_path, width, height, file_size and, where there are
    any, make, model and extracted_text.
    """
    r = _Row(photos, typed=False)
    like, bare = r.name.rlike, ~r.camera
    roll, shot = r.once(roll=like(CAMERA_ROLL), shot=screenshot_category().isNotNull())
    raw = r.ext.isin("dng", "raw", "cr2", "nef", "arw")
    plain = bare & ~roll
    (app,) = r.once(app=_first([
        ("whatsapp", 60, like(WHATSAPP_NAME)), ("whatsapp", 55, like(WHATSAPP_EXPORT)), ("whatsapp", 50, like(WHATSAPP_PREFIX)),
        ("whatsapp", 50, like(WHATSAPP_CODE) & bare), ("whatsapp", 50, r.within("/whatsapp/", "whatsapp images", "whatsapp video", "whatsapp stickers")),
        ("instagram", 55, like(INSTAGRAM_HASH)), ("instagram", 50, like(INSTAGRAM_PREFIX) | r.within("/instagram/", "/ig/")),
        ("snapchat", 50, like(r"^snapchat[-_]\d+|^snap[-_]\d+") | r.within("/snapchat/")),
        ("linkedin", 50, like(LINKEDIN + "|^linkedin_") | r.within("/linkedin/")), ("editor", 45, like(EDITOR) | r.within(*EDITOR_FOLDERS)),
        ("browser", 45, like(DOWNLOAD) | (r.path.rlike(DOWNLOAD_FOLDER) & bare)),
        ("other-social", 50, like(TELEGRAM + r"|^received_\d+|^fb_img_\d+|^rdt_\d+|^(twitter|tw|x_export)[-_]|^(tiktok|snaptik|ssstik)")),
        ("other-social", 50, r.within("/telegram/", "/facebook/", "/messenger/", "/reddit/", "/twitter/", "/tiktok/")),
        ("other-apps", 35, plain & like(r"^[0-9a-f]{20,32}\.(jpg|png|webp|gif)|" + UUID)),
    ]))
    ratio = F.when(r.sized, r.longer / r.shorter)
    banner, small, square, quote, sticker, squeezed = r.once(
        banner=r.sized & plain & (ratio >= 2.4) & (r.ext != "png"), small=r.sized & plain & (r.longer <= 400) & (r.size < 150 * KB), square=r.sized & plain & (r.w == r.h) & r.w.between(450, 1440),
        quote=plain & F.length(r.text).between(21, 499) & r.text.rlike(QUOTES), sticker=(r.ext == "webp") & ((r.sized & (r.longer <= 800)) | ((r.size > 0) & (r.size < 300 * KB))),
        squeezed=r.sized & (r.size > 0) & plain & (r.w * r.h > 200_000) & (r.size / (r.w * r.h) < 0.18),
    )
    original = r.camera | roll | raw
    stripped = ~original & r.ext.isin("jpg", "jpeg", "png", "mov", "mp4", "webp", "m4v")
    signals = [(30, banner), (35, small), (25, square), (30, quote), (40, sticker), (15, fits(r.w, r.h, PLATFORM_SIZES)), (25, squeezed), (-60, original), (25, stripped)]
    score = _bounded(F.coalesce(app["points"], F.lit(0)) + _sum(signals))
    guess = F.when(square | quote | sticker | squeezed, "other-apps").when(banner | small, "browser").otherwise("other-apps")
    found = F.coalesce(app["category"], guess)
    out = made_once(r.df, app_score=F.when(shot, 0).otherwise(score), app_category=F.when(shot, "other-apps").otherwise(found))
    kind = F.when(F.col("app_score") >= 60, "app-media").when(F.col("app_score") >= 35, "uncertain").otherwise("keep")
    return r.plain(out.withColumn("app_class", kind))


def app_counts(classified: DataFrame) -> DataFrame:
    """Photos and bytes by app of what ``app_media`` doesn't keep, and of ``all``; apps without any count 0."""
    found = classified.filter("app_class <> 'keep'").select("app_category", "file_size")
    sums = found.groupBy("app_category").agg(F.count("*").alias("n"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("n_bytes"))
    # each app's row is a row of its own and part of the whole
    rows = sums.select(F.explode(F.array("app_category", F.lit("all"))).alias("category"), "n", "n_bytes")
    every = classified.sparkSession.createDataFrame([(k,) for k in ("all", *APPS)], "category string")
    both = every.join(rows, "category", "left").groupBy("category")
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"))


def forwarded_media(files: DataFrame) -> DataFrame:
    """``files`` with ``junk_class`` (junk from 70, uncertain from 40, else keep), ``junk_score`` and ``junk_category``; what is neither picture nor film is kept.

    A picture without metadata in a folder of an app is junk at once (95), and so is a sticker (90). Looks at filename, file_path, width, height,
    file_size and, where there are any, has_exif, make, model, gps_lat, bit_rate, video_width and video_height.
    """
    r = _Row(files)
    like = r.name.rlike
    named = _first([
        ("whatsapp", 50, like(WHATSAPP_NAME + "|" + WHATSAPP_EXPORT)), ("whatsapp", 45, like(WHATSAPP_PREFIX)), ("whatsapp", 40, like(WHATSAPP_CODE)),
        ("instagram", 50, like(INSTAGRAM_HASH)), ("instagram", 40, like(INSTAGRAM_PREFIX)), ("snapchat", 45, like(r"^snapchat-\d+|^snap[-_]\d+")),
        ("linkedin", 45, like(LINKEDIN)), ("editor", 45, like(EDITOR)), ("browser", 40, like(ANY_DOWNLOAD)),
        ("other-social", 50, like(TELEGRAM + "|" + TELEGRAM.replace("photo", "video"))),
        ("other-social", 45, like(r"^received_\d+|^fb_img_\d+|^rdt_\d+|^(reddit|twitter|tw|x_export)[-_]|^(tiktok|snaptik|ssstik)")),
        ("other-apps", 25, ~like("^(img_|dsc_|pxl_|dji_|gopr|sam_|dcim)") & like(r"^[0-9a-f]{16,32}\.|^[0-9]{12,20}\.|" + UUID)),
    ])
    placed = _first([
        ("whatsapp", 40, r.within("whatsapp images", "whatsapp video", "/whatsapp/")), ("instagram", 40, r.within("/instagram/", "/ig/")),
        ("snapchat", 40, r.within("/snapchat/")), ("linkedin", 40, r.within("/linkedin/")), ("editor", 40, r.within("/canva/", *EDITOR_FOLDERS)),
        ("browser", 35, r.within("/downloads/", "/chrome/", "/safari/", "/browser/")),
        ("other-social", 40, r.within("/telegram/", "/facebook/", "/messenger/", "/reddit/", "/twitter/", "/tiktok/")),
    ])
    seen = r.picture & r.sized
    sticker = (r.ext == "webp") & ((seen & (r.longer <= 800)) | ((r.size > 0) & (r.size < 250 * KB)))
    banner = seen & (r.longer >= 2.4 * r.shorter)
    camera = r.camera | r.gps_lat.isNotNull()
    caps = ((r.film_w <= 848) & (r.film_h <= 480)) | ((r.film_w <= 480) & (r.film_h <= 848))
    signals = [
        (40, sticker), (15, seen & fits(r.w, r.h, PLATFORM_SIZES)), (20, seen & (r.size > 0) & (r.w * r.h > 200_000) & (r.size / (r.w * r.h) < 0.22)),
        (25, seen & (r.w == r.h) & r.w.between(450, 1440)), (30, banner), (25, r.picture & ~r.any_exif), (-60, r.picture & camera),
        (20, r.film & caps & (r.rate > 0) & (r.rate < 1_800_000)),
    ]
    points = lambda x: F.coalesce(x["points"], F.lit(0))
    media = r.picture | r.film
    sent = placed.isNotNull() & ~r.any_exif & r.picture & ~camera
    score = F.when(~media, 0).when(sent, 95).when(sticker, 90).otherwise(_bounded(points(named) + points(placed) + _sum(signals)))
    category = F.when(sticker, "other-apps").otherwise(F.coalesce(placed["category"], named["category"], F.lit("other-apps")))
    category = F.when(banner & (category == "other-apps"), "browser").otherwise(category)
    category = F.when(sticker & ~sent, "other-apps").otherwise(category)
    out = made_once(r.df, junk_score=score, junk_category=F.when(media, category))
    return r.plain(out.withColumn("junk_class", F.when(F.col("junk_score") >= 70, "junk").when(F.col("junk_score") >= 40, "uncertain").otherwise("keep")))


def screenshot_score(files: DataFrame) -> DataFrame:
    """``files`` with ``shot_score`` and ``shot_class``: screenshot from 60, uncertain from 30, else photo.

    A flag of the system, or a system's own name without camera data, decides at once (100). Looks at filename, file_path, width, height and, where
    there are any, os_native, metadata_failed, software (text of the metadata), make, model, f_number, iso, exposure_time, gps_lat, gps_lon, video_make
    and video_model.
    """
    r = _Row(files)
    png, read = r.ext == "png", ~r.unread
    placed = lambda x: F.coalesce(x != 0, F.lit(False))
    camera = F.when(r.film, r.film_camera).otherwise(read & (r.camera | placed(r.gps_lat)))
    exact = r.name.rlike(EXACT_SHOT)
    named = exact | (F.contains(r.name, F.lit("screenshot")) & r.name.rlike(r"\d{4}-\d{2}-\d{2}|\d{8}")) | r.name.rlike(SHOT_WORD)
    untouched = ~reduce(lambda a, b: a | b, [r.camera, *r.exif, placed(r.gps_lat), placed(r.gps_lon)])
    picture = [(30, read & png & r.software.rlike(SHOT_TOOLS)), (20, read & png & untouched), (15, fits(r.w, r.h, DISPLAY_SIZES))]
    score = _sum([(40, named), (-50, camera)]) + F.when(r.picture, _sum(picture)).otherwise(0)
    score = F.when(~(r.picture | r.film), 0).when(r.native_flag, 100).when(exact & ~camera, 100).otherwise(score)
    out, score = made_once(r.df, shot_score=score), F.col("shot_score")
    return r.plain(out.withColumn("shot_class", F.when(score >= 60, "screenshot").when(score >= 30, "uncertain").otherwise("photo")))
