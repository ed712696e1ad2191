"""Library organization: a folder for every photo, previews, validation, free names and audits."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions.scalars import sanitize_folder
from shutterlake.sources.media import media_type

CATEGORIES = ("duplicates", "documents", "screenshots", "whatsapp", "social", "people", "places", "favorites", "videos")


@dataclass(frozen=True)
class PlanOptions:
    """Which categories get folders of their own, whether the category or the year comes first, and which people and places count (None: all)."""

    category_first: bool = False
    year_month: bool = False
    separate: frozenset[str] = field(default_factory=lambda: frozenset(CATEGORIES))
    people: tuple[str, ...] | None = None
    places: tuple[str, ...] | None = None


def kinds() -> dict[str, Column]:
    """What a photo's name, path and flags say it is."""
    name, path = F.lower(F.coalesce("filename", F.lit(""))), F.lower(F.coalesce("file_path", F.lit("")))
    return {
        "screenshot": name.rlike("screenshot|screen shot|screencap|^ss_|^scr_") | path.rlike("screenshot|screen shot|screencaps"),
        "video": F.lower(F.coalesce("mime_type", F.lit(""))).startswith("video") | F.coalesce(media_type(F.coalesce(F.nullif("filename", F.lit("")), "file_path"))["kind"].isin("video", "cinema"), F.lit(False)),
        "document": F.coalesce(F.col("is_document"), F.lit(False)) | F.coalesce(~F.col("document_category").isin("", "not_a_document"), F.lit(False)) | name.rlike(r"aadhaar|aadhar|adhar|pan_card|pancard|passport|receipt|invoice|bill_|\.pdf$|\.txt$"),
        "whatsapp": path.rlike("/whatsapp/|whatsapp images|whatsapp video") | name.rlike(r"^(img|vid|stk)-[0-9]{8}-wa[0-9]{4,}\.|whatsapp (image|video|audio|document) [0-9]{4}-[0-9]{2}-[0-9]{2}|^wa[-_]?[0-9]+|^[a-z]{4,7}[0-9]{4,5}\.(jpg|jpeg|mov|mp4|png|webp)$"),
        "social": path.rlike("/instagram/|/snapchat/|/facebook/|/tiktok/") | name.rlike(r"^[0-9]{6,15}_[0-9]{10,25}_[0-9]{10,25}_[no]\.(jpg|mp4|webp)$|^(instagram|ig|reels|snapchat|snap|tiktok|fb_img)[-_]"),
    }


def plan_candidates(photos: DataFrame, exif: DataFrame, ids: DataFrame | None = None, prefix: str | None = None) -> DataFrame:
    """Live photos with their coordinates, newest first: those whose id is in ``ids(id)``, or else whose path starts with ``prefix``, or else all."""
    live = photos.filter("not is_trashed")
    if ids is not None:
        live = live.join(ids.select("id").distinct(), "id", "left_semi")
    elif prefix:
        live = live.filter(F.col("file_path").startswith(prefix))
    places = exif.select(F.col("photo_id").alias("id"), "gps_lat", "gps_lon")
    return live.join(places, "id", "left").orderBy(F.desc("created_at"), F.desc("id"))


def planned(photos: DataFrame, options: PlanOptions = PlanOptions(), excluded: DataFrame | None = None) -> DataFrame:
    """``photos`` with ``target_folder`` and ``category``.

    Expects ``is_duplicate``, ``names`` (sorted names of its people) and coordinates beside the photo's columns. ``excluded(id, category)``: photos
    that a category must not take; they fall through to the next that fits.
    """
    out = photos
    if excluded is not None:
        out = out.join(excluded.groupBy("id").agg(F.collect_set("category").alias("_not")), "id", "left")
    allowed = lambda c: F.lit(c in options.separate) & (F.lit(True) if excluded is None else ~F.coalesce(F.array_contains("_not", c), F.lit(False)))
    k = kinds()
    year = F.coalesce(F.date_format("created_at", "yyyy"), F.lit("No Date"))
    month = F.coalesce(F.date_format("created_at", "MMMM"), F.lit("General"))
    join = lambda *parts: F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    order = lambda name, *rest, year_last=True: join(name, *(rest or ((year,) if year_last else ()))) if options.category_first else join(year, name, *rest)
    named = F.filter(F.coalesce("names", F.array().cast("array<string>")), lambda n: (F.trim(n) != "") & ~F.lower(n).startswith("unknown person"))
    if options.people is not None:
        named = F.filter(named, lambda n: F.lower(F.trim(n)).isin([p.strip().lower() for p in options.people]))
    place = F.when(F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull() & (F.trim("location_name") != ""), F.trim("location_name"))
    if options.places is not None:
        place = F.when(F.lower(place).isin([p.strip().lower() for p in options.places]), place)
    videos = "videos" in options.separate
    general = "Photos" if videos else "Photos & Videos"
    video_here = k["video"] & allowed("videos")
    rules = [
        (allowed("duplicates") & F.col("is_duplicate"), "Duplicates", order("Duplicates (Review)", year_last=False)),
        (allowed("documents") & k["document"], "Documents", order("Documents", F.when(F.col("document_category").isNotNull(), sanitize_folder(F.col("document_category"))).otherwise("General Documents"))),
        (allowed("screenshots") & k["screenshot"], "Screenshots", order("Screenshots")),
        (allowed("whatsapp") & k["whatsapp"], "WhatsApp", order("WhatsApp", F.when(k["video"], "Videos").otherwise("Photos")) if videos else order("WhatsApp", year_last=False)),
        (allowed("social") & k["social"], "Social Media", order("Social Media")),
        (allowed("people") & (F.size(named) > 0), "People", order("People", sanitize_folder(F.array_join(F.slice(named, 1, 2), " & ")))),
        (allowed("places") & place.isNotNull(), "Places", join("Places", sanitize_folder(place)) if options.category_first else join(year, F.concat(F.lit("Trip - "), sanitize_folder(place)))),
        (allowed("favorites") & F.col("is_favorite"), "Favorites", order("Favorites")), (video_here, "Videos", order("Videos")),
    ]
    default = (join(general, year, month) if options.category_first else join(year, month), F.when(k["video"], "Photos & Videos").otherwise("Photos"))
    if options.year_month:
        return out.withColumns({"target_folder": join(year, month), "category": F.when(k["video"], "Videos" if videos else "Photos & Videos").otherwise("Photos")}).drop("_not")
    folder, category = default
    for cond, label, target in reversed(rules):
        hit = F.coalesce(cond, F.lit(False))
        folder, category = F.when(hit, target).otherwise(folder), F.when(hit, label).otherwise(category)
    return out.withColumns({"target_folder": folder, "category": category}).drop("_not")


def preview(plan: DataFrame, samples: int = 3) -> DataFrame:
    """Files, bytes and the first sample names of each target folder, with its top folder; years descending, 'No Date' last."""
    w = Window.partitionBy("target_folder").orderBy(F.desc("created_at"), F.desc("id"))
    first = plan.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= samples).groupBy("target_folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "filename"))), lambda x: x["filename"]), ", ").alias("samples"))
    sums = plan.groupBy("target_folder").agg(F.count("*").alias("n"), F.sum("file_size").alias("n_bytes"))
    top = F.substring_index("target_folder", "/", 1)
    return sums.join(first, "target_folder").withColumn("top_folder", top).orderBy(F.col("top_folder") == "No Date", F.desc("top_folder"), F.desc("n"), "target_folder")


def validated(plan: DataFrame, disk: DataFrame, skip: bool = False) -> DataFrame:
    """``plan`` with ``status``: its source is missing, it is the first for its target, or it collides with an earlier one (newest first) and is renamed or skipped."""
    target = F.lower(F.concat_ws("/", "target_folder", "filename"))
    there = plan.join(disk.select(F.col("path").alias("file_path"), F.col("length").alias("disk_size")).dropDuplicates(["file_path"]), "file_path", "left")
    rank = F.row_number().over(Window.partitionBy(target, F.col("disk_size").isNull()).orderBy(F.desc("created_at"), F.desc("id")))
    ranked = there.withColumn("collision_rank", rank)
    status = F.when(F.col("disk_size").isNull(), "missing_source").when(F.col("collision_rank") == 1, "matched").otherwise("collision_skipped" if skip else "collision_renamed")
    return ranked.withColumn("status", status)


def free_names(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """``plan(id, folder, name)`` with ``new_name``: the name itself if free, else with the smallest free ' (n)', given out in id order.

    Names are compared in lower case. Of k files that want a name, the k-th takes the k-th number that no existing file has. Below the j-th taken
    number t are t - j + 1 free ones, so it is k - 1 and as many more as there are taken numbers with no more than k - 1 free ones below: both kinds are
    merged in that order and the last taken number before each file is its answer. Linear in files and taken numbers. ``existing(folder, name)``.
    """
    split = lambda df: df.withColumns({"stem": F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), "ext": F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 2)})
    numbered = r"^(.*) \(([0-9]+)\)$"
    old = split(existing).select("folder", F.explode(F.array(F.struct(F.lower("stem").alias("stem"), F.lit(0).alias("n")), F.struct(F.lower(F.regexp_extract("stem", numbered, 1)).alias("stem"), F.nullif(F.regexp_extract("stem", numbered, 2), F.lit("")).try_cast("int").alias("n")))).alias("x"), F.lower("ext").alias("lower_ext"))
    keys = ["folder", "lower_stem", "lower_ext"]
    taken = old.select("folder", F.col("x.stem").alias("lower_stem"), "lower_ext", "x.n").filter("n is not null and lower_stem <> ''").distinct()
    taken = taken.withColumn("j", F.row_number().over(Window.partitionBy(*keys).orderBy("n"))).select(*keys, (F.col("n") - F.col("j") + 1).alias("at"), "j")
    want = split(plan).withColumns({"lower_stem": F.lower("stem"), "lower_ext": F.lower("ext")})
    want = want.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("id")) - 1)
    merged = want.unionByName(taken, allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy("at", F.col("j").isNull(), "j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = merged.withColumn("passed", F.coalesce(F.max("j").over(before), F.lit(0))).filter("j is null")
    n = F.col("at") + F.col("passed")
    return both.select(*plan.columns, F.when(n == 0, F.col("name")).otherwise(F.concat("stem", F.lit(" ("), n.cast("string"), F.lit(")"), "ext")).alias("new_name"))


def audited(manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """``manifest(path, size)`` against ``disk(path, length)``: ok, missing, resized or unexpected."""
    both = manifest.join(disk, "path", "full_outer")
    status = F.when(F.col("length").isNull(), "missing").when(F.col("size").isNull(), "unexpected").when(F.col("size") != F.col("length"), "resized").otherwise("ok")
    return both.select("path", status.alias("status"))


def source_breakdown(files: DataFrame) -> DataFrame:
    """Files and bytes by media or other, and extension."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./\\]*)$", 1))
    return files.groupBy(F.when(media_type(F.col("path"))["supported"], "media").otherwise("other").alias("side"), ext.alias("ext")).agg(F.count("*").alias("n"), F.sum("length").alias("n_bytes"))


def move_plan(files: DataFrame, root: str, dest: str, keep_subpath: bool = True) -> DataFrame:
    """``files(path)`` with the path each moves to; ``undo`` of a plan is the same frame with the two columns exchanged."""
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    sub = F.when(F.col("path").startswith(root + "/"), F.substring(F.col("path"), len(root) + 2, 1 << 20)).otherwise(name) if keep_subpath else name
    return files.withColumn("new_path", F.concat(F.lit(dest + "/"), sub))
