"""Filters, joins and aggregates over a media catalogue."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.operators.once import made_once
from shutterlake.session import cut
from shutterlake.sources.media import media_type

MB = 1024 * 1024


@dataclass(frozen=True)
class PhotoFilter:
    """What to show. ``None`` for a flag means its default: not locked, not trashed, and not archived unless trash is asked for."""

    favorite: bool | None = None
    trashed: bool | None = None
    archived: bool | None = None
    locked: bool | None = None
    folder: str | None = None
    search: str | None = None
    limit: int = 0
    offset: int = 0


def page_starts(photos: DataFrame, size: int = 100) -> DataFrame:
    """``(page, created_at, id)``: the first row of each page of ``size``, newest first, pages from 0. Ranks are made by ranges: none but its own is sorted by a task."""
    order = [F.desc("created_at"), F.desc("id")]
    rows = cut(photos.select("created_at", "id").repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a range
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    ranked = rows.join(F.broadcast(before), "_part").withColumn("_rank", rank)
    return ranked.filter(F.col("_rank") % size == 0).select((F.col("_rank") / size).cast("long").alias("page"), "created_at", "id")


def keyset_page(photos: DataFrame, starts: DataFrame, page: int) -> DataFrame:
    """The rows of a page of ``page_starts``, newest first, by a range of (created_at, id) that reaches the scan. A page that isn't there is empty."""
    found = {r.page: r for r in starts.filter(F.col("page").isin(page, page + 1)).collect()}  # two rows
    if page not in found:
        return photos.filter(F.lit(False))
    at, i = F.col("created_at"), F.col("id")
    first = found[page]
    out = photos.filter(at <= first.created_at).filter((at < first.created_at) | (i <= first.id))
    if last := found.get(page + 1):
        out = out.filter(at >= last.created_at).filter((at > last.created_at) | (i > last.id))
    return out.orderBy(F.desc("created_at"), F.desc("id"))


def date_groups(photos: DataFrame) -> DataFrame:
    """``(day, id, rank)``: every photo with its place, from 1, among those of its day. Rows, not lists, so a day may hold any number."""
    day = F.coalesce(F.to_date("created_at").cast("string"), F.lit("Unknown Date"))
    rows = photos.select(day.alias("day"), "id")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy("id")).cast("long"))


def search_ids(photos: DataFrame, exif: DataFrame, photo_people: DataFrame | None, people: DataFrame | None, text: str) -> DataFrame:
    """Ids of photos whose text fields, camera or people, where given, hold ``text`` in any case. A union of ids keeps every join an equi-join."""
    like = lambda *names: [F.col(c).ilike(f"%{text}%") for c in names]
    any_of = lambda cs: F.coalesce(*[F.when(c, True) for c in cs], F.lit(False))
    own = photos.filter(any_of(like("filename", "description", "location_name", "extracted_text"))).select("id")
    camera = exif.filter(any_of(like("make", "model"))).select(F.col("photo_id").alias("id"))
    if photo_people is None or people is None:
        return own.union(camera).distinct()
    named = photo_people.join(people.filter(F.col("name").ilike(f"%{text}%")).select(F.col("id").alias("person_id")), "person_id", "left_semi").select(F.col("photo_id").alias("id"))
    return own.union(camera).union(named).distinct()


def filtered_photos(photos: DataFrame, exif: DataFrame, want: PhotoFilter, matching: DataFrame | None = None, photo_people: DataFrame | None = None, people: DataFrame | None = None) -> DataFrame:
    """Photos with their camera data, newest first, ties by larger id. ``matching(id)``: photos that an album allows. ``want.search`` is that of ``search_ids``."""
    trashed = bool(want.trashed)
    cond = (F.col("is_locked") == bool(want.locked)) & (F.col("is_trashed") == trashed)
    if want.archived is not None or not trashed:
        cond &= F.col("is_archived") == bool(want.archived)
    if want.favorite is not None:
        cond &= F.col("is_favorite") == want.favorite
    if want.folder:
        cond &= F.col("source_folder_path") == want.folder
    out = photos.filter(cond)
    if want.search:
        out = out.join(search_ids(photos, exif, photo_people, people, want.search), "id", "left_semi")
    if matching is not None:
        out = out.join(matching, "id", "left_semi")
    out = out.join(exif, out.id == exif.photo_id, "left").drop("photo_id").orderBy(F.desc("created_at"), F.desc("id"))
    out = out.offset(want.offset) if want.offset else out
    return out.limit(want.limit) if want.limit else out


def timeline(photos: DataFrame, archived: bool = False) -> DataFrame:
    """Photos per day, newest first, without trash (and archive unless asked for)."""
    seen = ~F.col("is_trashed") if archived else ~F.col("is_trashed") & ~F.col("is_archived")
    return photos.filter(seen).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day"))


def stats(photos: DataFrame, albums: DataFrame) -> DataFrame:
    live = ~F.col("is_trashed")
    one = photos.agg(F.count_if(live).alias("n_photos"), F.coalesce(F.sum(F.when(live, F.col("file_size"))), F.lit(0)).alias("n_bytes"), F.count_if(live & F.col("is_favorite")).alias("n_favorites"))
    return one.crossJoin(albums.agg(F.count("*").alias("n_albums")))  # one row each


def through(photos: DataFrame, bridge: DataFrame, key: str) -> DataFrame:
    """Live photos with the ``key`` of each bridge row."""
    return photos.filter(~F.col("is_trashed")).join(bridge.withColumnRenamed("photo_id", "id"), "id")


def folder_ancestors(photos: DataFrame) -> DataFrame:
    """``(id, folder_path)``: each live photo with every folder above its file, so that prefix joins are equi-joins."""
    parts = F.split("source_folder_path", "/")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return photos.filter(~F.col("is_trashed")).select("id", F.explode(upto).alias("folder_path"))


def folder_counts(photos: DataFrame, folders: DataFrame) -> DataFrame:
    """Live photos in or below each folder."""
    inside = folder_ancestors(photos).groupBy("folder_path").agg(F.count("*").alias("n"))
    return folders.join(inside, "folder_path", "left").select("folder_path", F.coalesce("n", F.lit(0)).alias("n"))


def counted(dimension: DataFrame, bridge: DataFrame, key: str, photos: DataFrame | None = None) -> DataFrame:
    """``dimension`` with the bridge rows of each id as ``n``; only those of live photos if ``photos`` are given."""
    if photos is not None:
        bridge = bridge.join(photos.filter(~F.col("is_trashed")).select(F.col("id").alias("photo_id")), "photo_id", "left_semi")
    n = bridge.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"))
    return dimension.join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def orphans(photos: DataFrame, photo_people: DataFrame, people: DataFrame, folders: DataFrame) -> DataFrame:
    """Bridge rows without a photo, people without photos and photos of folders that aren't imported, counted by kind. Null-safe anti joins."""
    ids = photos.select(F.col("id").alias("photo_id"))
    bridge = photo_people.join(ids, "photo_id", "left_anti").agg(F.count("*").alias("n")).withColumn("kind", F.lit("bridge"))
    lonely = people.join(photo_people.select(F.col("person_id").alias("id")), "id", "left_anti").agg(F.count("*").alias("n")).withColumn("kind", F.lit("people"))
    homeless = photos.join(folders.select(F.col("folder_path").alias("source_folder_path")), "source_folder_path", "left_anti").agg(F.count("*").alias("n")).withColumn("kind", F.lit("photos"))
    return bridge.unionByName(lonely).unionByName(homeless).select("kind", "n")


def is_video() -> Column:
    """By media type, or by extension."""
    return F.coalesce(F.col("mime_type").startswith("video/"), F.lit(False)) | F.coalesce(media_type(F.col("filename"))["kind"].isin("video", "cinema"), F.lit(False))


def large_files(photos: DataFrame, least: int = 50 * MB, kind: str = "all") -> DataFrame:
    out = photos.filter((F.col("file_size") >= least) & ~F.col("is_trashed"))
    return out if kind == "all" else out.filter(is_video() if kind == "video" else ~is_video())


def memories(photos: DataFrame, now: Column) -> DataFrame:
    """The same month a year ago; favourites if there are two; the first ten if there are three. One row for each (kind, id)."""
    live = photos.filter(~F.col("is_trashed"))
    then = F.add_months(now, -12)
    past = live.filter((F.year("created_at") == F.year(then)) & (F.month("created_at") == F.month(then))).select(F.lit("last_year").alias("kind"), "id")
    gate = lambda df, kind, least: df.crossJoin(df.agg(F.count("*").alias("all"))).filter(F.col("all") >= least).select(F.lit(kind).alias("kind"), "id")
    loved = gate(live.filter("is_favorite").select("id"), "favorites", 2)
    first = live.orderBy(F.desc("created_at"), F.desc("id")).limit(10).select("id")
    return past.unionByName(loved).unionByName(gate(first, "highlights", 3))


def cleanup_stats(photos: DataFrame) -> DataFrame:
    """Counts and bytes of live photos by what could go, and in all: large files, media of apps (``app_media`` doesn't keep them), screenshots and ``quick_duplicates``. Classes may overlap; a photo in two counts twice in all, as it does in each."""
    from shutterlake.operators.app_media import app_media
    from shutterlake.operators.classify import screenshot_category

    live, size = photos.filter(~F.col("is_trashed")), F.coalesce("file_size", F.lit(0))
    film = F.coalesce(media_type(F.col("file_path"))["kind"].isin("video", "cinema"), F.lit(False))
    large = (size >= 25 * MB) | (film & (size >= 15 * MB))
    marked = made_once(app_media(live), _large=large, _shot=screenshot_category().isNotNull()).select(size.alias("size"), F.array_compact(F.array(
        F.when(F.col("_large"), "large"), F.when(F.col("app_class") != "keep", "app_media"), F.when(F.col("_shot"), "screenshots"),
    )).alias("kinds"))
    sums = marked.select("size", F.explode("kinds").alias("category")).groupBy("category").agg(F.count("*").alias("n"), F.sum("size").alias("n_bytes"))
    copies = quick_duplicates(photos).select(F.lit("duplicates").alias("category"), F.col("n_redundant").alias("n"), F.col("freed").alias("n_bytes"))
    rows = sums.unionByName(copies).select(F.explode(F.array("category", F.lit("all"))).alias("category"), "n", "n_bytes")
    every = photos.sparkSession.createDataFrame([(k,) for k in ("large", "app_media", "screenshots", "duplicates", "all")], "category string")
    both = every.join(rows, "category", "left").groupBy("category")
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"))


def quick_duplicates(photos: DataFrame) -> DataFrame:
    """Groups by hash, if it has 64 digits that aren't all zero, else by size and dimensions; what all but the largest of each would free. Empty files count for nothing."""
    text = lambda *parts: F.concat_ws("_", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    hashed = (F.length("perceptual_hash") == 64) & (F.col("perceptual_hash") != "0" * 64)
    sized = (F.col("width") != 0) & (F.col("height") != 0)
    key = F.when(hashed, text("hash", F.col("perceptual_hash"))).when(sized, text("dim", F.col("file_size"), F.col("width"), F.col("height"))).otherwise(text("size", F.col("file_size")))
    groups = photos.filter(~F.col("is_trashed") & (F.col("file_size") > 0)).groupBy(key.alias("key")).agg(F.count("*").alias("n"), (F.sum("file_size") - F.max("file_size")).alias("freed")).filter("n > 1")
    return groups.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_redundant"), F.coalesce(F.sum("freed"), F.lit(0)).alias("freed"))


def exact_median(df: DataFrame, score: str) -> float | None:
    """The middle of the values of ``score``, or the mean of the two middle ones; null if there is none.

    Values are counted first, so a frequent one is a row; their counts are summed by ranges, and only the range that holds the middle is sorted.
    """
    values = df.select(F.col(score).cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    values = cut(values.repartitionByRange("v").withColumn("_part", F.spark_partition_id()))
    ranges = sorted(values.groupBy("_part").agg(F.sum("n")).collect())  # a row a range
    total, middle = sum(n for _, n in ranges), []
    for rank in {(total - 1) // 2, total // 2} if total else ():
        before = 0
        for part, n in ranges:
            if before + n > rank:
                run = F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
                own = values.filter(F.col("_part") == part).withColumn("_run", run)
                middle.append(own.filter(F.col("_run") > rank - before).agg(F.min("v")).first()[0])
                break
            before += n
    return sum(middle) / len(middle) if middle else None


def score_summary(df: DataFrame, score: str) -> DataFrame:
    """Count, least, most, mean, exact median and deviation of ``score``: one row."""
    r = lambda c: F.round(c, 1)
    median = F.lit(exact_median(df, score)).cast("double")
    return df.agg(F.count(score).alias("n"), r(F.min(score)).alias("least"), r(F.max(score)).alias("most"), r(F.avg(score)).alias("mean"), r(median).alias("median"), r(F.stddev_pop(score)).alias("deviation"))


def threshold_metrics(df: DataFrame, score: str, truth: str, thresholds: Sequence[int]) -> DataFrame:
    """Confusion counts and rates at each threshold; each row meets each threshold, so the sums are made in one pass."""
    levels = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    hit = F.col(score) >= F.col("threshold")
    out = df.select(score, truth, levels).groupBy("threshold").agg(
        F.count_if(hit & F.col(truth)).alias("tp"), F.count_if(hit & ~F.col(truth)).alias("fp"), F.count_if(~hit & ~F.col(truth)).alias("tn"), F.count_if(~hit & F.col(truth)).alias("fn"))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    return out.withColumns({"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "f1": rate(2 * tp, 2 * tp + fp + fn), "accuracy": rate(tp + tn, tp + fp + tn + fn)})


def table_health(photos: DataFrame, exif: DataFrame, photo_people: DataFrame) -> DataFrame:
    """Broken rules of the catalogue, counted."""
    check = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
    ids = photos.select(F.col("id").alias("photo_id"))
    parts = [
        check("photo id repeated", photos.groupBy("id").count().filter("count > 1")), check("file path repeated", photos.groupBy("file_path").count().filter("count > 1")),
        check("file path missing", photos.filter("file_path is null or file_path = ''")), check("exif without photo", exif.join(ids, "photo_id", "left_anti")), check("person without photo", photo_people.join(ids, "photo_id", "left_anti")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sessions(df: DataFrame, ts: str, keys: Sequence[str] = (), gap_s: int = 12_600, same_day: bool = True, tie: str = "id") -> DataFrame:
    """``df`` with ``session``, counted from 1 by key: a new one starts after more than ``gap_s`` seconds, or on a new day.

    Days are a partition of their own when sessions end with the day, so that no window spans all rows; the number then is within the day.
    """
    parts = [F.col(k) for k in keys] + ([F.to_date(ts)] if same_day else [])
    w = Window.partitionBy(*parts).orderBy(ts, tie)
    gap = F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w))
    return df.withColumn("session", F.sum(F.when((gap > gap_s) | gap.isNull(), 1).otherwise(0)).over(w))


def trip_windows(df: DataFrame, max_gap_days: int = 2) -> DataFrame:
    """Runs of days at one location with gaps of at most ``max_gap_days``: start, end, year, photos. ``df(location_name, created_at)``."""
    days = df.filter(F.col("location_name").isNotNull() & ~F.col("location_name").isin("", "Unknown Location")).groupBy("location_name", F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("location_name").orderBy("day")
    new = F.coalesce(F.datediff("day", F.lag("day").over(w)) > max_gap_days, F.lit(True))
    runs = days.withColumn("trip", F.sum(new.cast("int")).over(w))
    return runs.groupBy("location_name", "trip").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.year(F.min("day")).alias("year"), F.sum("n").alias("n"))


def later_copies(photos: DataFrame, key: str) -> DataFrame:
    """All but the first row by id of each key that isn't empty."""
    first = photos.filter(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.min("id").alias("first_id"))
    return photos.join(first, key).filter(F.col("id") > F.col("first_id"))


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key in an order, with ``rank``; the limit is applied before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def sync_diff(disk: DataFrame, photos: DataFrame) -> DataFrame:
    """``(path, change)``: media on disk that the catalogue lacks are added, photos that the disk lacks are removed. Slashes count as equal."""
    slashed = lambda c: F.regexp_replace(c, r"\\", "/")
    on_disk = disk.select(slashed("path").alias("path")).filter(media_type(F.col("path"))["supported"])
    known = photos.select(slashed("file_path").alias("path"))
    both = on_disk.distinct().withColumn("there", F.lit(True)).join(known.withColumn("known", F.lit(True)), "path", "full_outer")
    return both.filter("there is null or known is null").select("path", F.when(F.col("there"), "added").otherwise("removed").alias("change"))


def upserted(old: DataFrame, new: DataFrame, key: str, update: Sequence[str]) -> DataFrame:
    """``old`` with ``update`` columns taken from ``new`` where keys meet, and the rows of ``new`` that are new. Of rows of ``new`` with one key the first by all columns counts."""
    ranked = newest(new, [key], [F.col(c) for c in new.columns], 1).drop("rank")
    fresh = ranked.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in update])
    kept = old.join(fresh, key, "left").withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in update}).drop(*[f"_new_{c}" for c in update])
    added = ranked.join(old.select(key), key, "left_anti")
    return kept.unionByName(added, allowMissingColumns=True)


def with_ids(new: DataFrame, order: str, start: int) -> DataFrame:
    """``new`` with ids after ``start`` in an order: ranks within ranges and the sizes of the ranges before, so that no task orders all rows. Ranges are written once, so that ids stay."""
    parts = new.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    parts = cut(parts.withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33)))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    return parts.join(sizes.select("_part", before.alias("_before")), "_part").withColumn("id", F.lit(start) + F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def set_flag(photos: DataFrame, ids: DataFrame, flag: str, value: bool) -> DataFrame:
    """``photos`` with a flag set for ``ids(id)``."""
    marked = photos.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return marked.withColumn(flag, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(flag))).drop("_hit")


def purge(photos: DataFrame, bridge: DataFrame, people: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Photos, bridge rows and people left once ``ids(id)`` are deleted; people without photos go too."""
    photos = photos.join(ids, "id", "left_anti")
    bridge = bridge.join(ids.select(F.col("id").alias("photo_id")), "photo_id", "left_anti")
    return photos, bridge, people.join(bridge.select(F.col("person_id").alias("id")), "id", "left_semi")


def merged_people(people: DataFrame, photo_people: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """People and bridge after ``merges(old, new)``, chains followed to their end: a real name wins over 'Unknown Person', then the smaller id; bridge rows are distinct. ``moved_faces`` moves vectors."""
    ends = merge_ends(merges)
    real = lambda c: F.when(c != "Unknown Person", c)
    mapped = people.join(ends, people.id == ends.old, "left").withColumn("to", F.coalesce("new", "id"))
    own = F.struct((F.col("id") != F.col("to")).alias("moved"), "id")
    out = mapped.groupBy(F.col("to").alias("id")).agg(F.coalesce(F.min_by(real(F.col("name")), F.when(F.col("name") != "Unknown Person", own)), F.lit("Unknown Person")).alias("name"), F.min_by("cover_photo_id", own).alias("cover_photo_id"), F.bool_or("is_favorite").alias("is_favorite"))
    bridge = photo_people.join(ends, photo_people.person_id == ends.old, "left").select("photo_id", F.coalesce("new", "person_id").alias("person_id")).distinct()
    return out, bridge


def merge_ends(merges: DataFrame) -> DataFrame:
    """``merges(old, new)`` with ``new`` followed to the end of its chain by doubling; circles are an error."""
    now = cut(merges.select("old", "new").filter("old <> new"))
    for _ in range(40):
        step = now.alias("a").join(now.alias("b"), F.col("a.new") == F.col("b.old"), "left").select("a.old", F.coalesce("b.new", "a.new").alias("new"), F.col("b.new").isNotNull().alias("moved"))
        step = cut(step)
        if step.filter("moved").isEmpty():
            return now
        if not step.filter("old = new").isEmpty():
            raise ValueError("merges go in a circle")
        now = step.select("old", "new")
    raise ValueError("merges go in a circle")


def moved_faces(faces: DataFrame, merges: DataFrame) -> DataFrame:
    """``faces(..., person_id)`` with people merged."""
    ends = merge_ends(merges)
    return faces.join(ends, faces.person_id == ends.old, "left").withColumn("person_id", F.coalesce("new", "person_id")).drop("old", "new")


def exif_by_id(exif: DataFrame, photos: DataFrame, ids: DataFrame) -> DataFrame:
    """Camera data of the photos in ``ids(id)``; none where the photo itself is gone."""
    asked = photos.select("id").join(ids.select("id").distinct(), "id", "left_semi").withColumnRenamed("id", "photo_id")
    return exif.join(asked, "photo_id", "left_semi")


def location_input(photos: DataFrame, exif: DataFrame) -> DataFrame:
    """Live photos with their coordinates, oldest first: what places are filled from."""
    places = exif.select(F.col("photo_id").alias("id"), "gps_lat", "gps_lon")
    return photos.filter("not is_trashed").join(places, "id", "left").orderBy("created_at", "id")


def loaded_fingerprints(photos: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Live photos with what is known of their looks.

    Histograms and key frames are JSON text, null where it doesn't parse; ``color_histogram`` comes before ``rgb_histogram``. The difference hash is
    the photo's older one where it is missing; empty texts and zero seconds are null, sizes 0 and types image/jpeg where missing.
    """
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    doubles, texts = (lambda c: F.from_json(c, "array<double>")), (lambda c: F.from_json(c, "array<string>"))
    own = photos.filter("not is_trashed").join(fingerprints.withColumnRenamed("photo_id", "id"), "id", "left")
    return own.select(
        "id", "file_path", "filename", "created_at", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("file_size", "width", "height")], F.coalesce(text("mime_type"), F.lit("image/jpeg")).alias("mime_type"),
        *[text(c).alias(c) for c in ("sha256", "partial_sha256", "phash")], F.coalesce(text("dhash"), text("perceptual_hash")).alias("dhash"),
        doubles(F.coalesce("color_histogram", "rgb_histogram")).alias("color_histogram"), F.nullif("video_duration", F.lit(0.0)).alias("video_duration"), texts("video_keyframes").alias("video_keyframes"))
