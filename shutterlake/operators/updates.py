"""Changes of a catalogue as set operators: each takes frames and returns them changed, for any number of rows at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions.scalars import jittered
from shutterlake.operators.catalogue import newest, upserted, with_ids

#: What a reset puts back, by kind of scan.
RESETS = {
    "faces": {"faces_scanned": False},
    "locations": {"location_name": None},
    "documents": {"extracted_text": "", "is_document": False, "document_category": None},
    "utilities": {"blur_score": -1.0, "perceptual_hash": ""},
}


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with whole rows of ``new`` in place of those with their keys, nulls and all, and the rows of ``new`` that are new. Of rows of ``new`` with one key the first by all columns counts; columns that it lacks become null."""
    ranked = newest(new, [key], [F.col(c) for c in new.columns], 1).drop("rank")
    return old.join(ranked.select(key), key, "left_anti").unionByName(ranked, allowMissingColumns=True)


def trashed(photos: DataFrame, ids: DataFrame, value: bool, now: Column) -> DataFrame:
    """``photos`` with ``ids(id)`` put into the trash or taken out, ``trashed_at`` stamped or cleared with it."""
    if "trashed_at" not in photos.columns:
        photos = photos.withColumn("trashed_at", F.lit(None).cast("timestamp"))
    marked = photos.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    stamp = now.cast("timestamp") if value else F.lit(None).cast("timestamp")
    return marked.withColumns({"trashed_at": F.when(F.col("_hit"), stamp).otherwise(F.col("trashed_at")), "is_trashed": F.when(F.col("_hit"), F.lit(value)).otherwise(F.col("is_trashed"))}).drop("_hit")


def purged_rows(rows: DataFrame, ids: DataFrame, key: str = "photo_id") -> DataFrame:
    """Rows of a table that belongs to photos (fingerprints, camera data, bridges) without those of deleted ``ids(id)``."""
    return rows.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_anti")


def reset_scan(photos: DataFrame, kind: str) -> DataFrame:
    """``photos`` as before any scan of a kind: faces, locations, documents or utilities. For faces the people, bridges and vectors go too: ``df.limit(0)`` of each."""
    return photos.withColumns({c: F.lit(v).cast(photos.schema[c].dataType) for c, v in RESETS[kind].items()})


def saved_scan(photos: DataFrame, results: DataFrame) -> DataFrame:
    """``photos`` with ``results(id, extracted_text, is_document, document_category)`` written over; a blank text becomes NONE."""
    text = F.when(F.trim(F.coalesce("extracted_text", F.lit(""))) == "", "NONE").otherwise(F.col("extracted_text"))
    return _written(photos, results.withColumn("extracted_text", text), ["extracted_text", "is_document", "document_category"])


def saved_analysis(photos: DataFrame, results: DataFrame) -> DataFrame:
    """``photos`` with ``results(id, blur_score, perceptual_hash)`` written over."""
    return _written(photos, results, ["blur_score", "perceptual_hash"])


def saved_thumbnails(photos: DataFrame, results: DataFrame) -> DataFrame:
    """``photos`` with ``results(id, thumbnail_path, preview_path)`` written over."""
    lacking = {c: F.lit(None).cast("string") for c in ("thumbnail_path", "preview_path") if c not in photos.columns}
    return _written(photos.withColumns(lacking) if lacking else photos, results, ["thumbnail_path", "preview_path"])


def _written(photos: DataFrame, results: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values of ``results`` over those of ``photos``, nulls too; of results of one id the first by all columns. Ids that ``photos`` lacks are ignored."""
    one = newest(results.select("id", *columns), ["id"], [F.col(c) for c in columns], 1).select("id", F.struct(*columns).alias("_new"))
    out = photos.join(one, "id", "left")
    return out.withColumns({c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in columns}).drop("_new")


def saved_locations(photos: DataFrame, exif: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Photos and camera data with ``results(id, location_name, lat, lon)``: names are written over, coordinates only fill what is null; new rows of camera data have nothing else."""
    named = _written(photos, results, ["location_name"])
    placed = results.filter("lat is not null and lon is not null").select(F.col("id").alias("photo_id"), F.col("lat").alias("gps_lat"), F.col("lon").alias("gps_lon"))
    one = newest(placed, ["photo_id"], [F.col("gps_lat"), F.col("gps_lon")], 1).drop("rank")
    both = exif.join(one.select("photo_id", F.struct("gps_lat", "gps_lon").alias("_new")), "photo_id", "left")
    kept = both.withColumns({c: F.coalesce(F.col(c), F.col(f"_new.{c}")) for c in ("gps_lat", "gps_lon")}).drop("_new")
    return named, kept.unionByName(one.join(exif.select("photo_id"), "photo_id", "left_anti"), allowMissingColumns=True)


def location_scan(photos: DataFrame, exif: DataFrame, propagated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Photos and camera data after a scan: ``propagated(id, location_name, lat, lon, is_inferred)`` is written back where it has coordinates, inferred ones moved a little by their id."""
    at = lambda c: F.when(F.col("is_inferred"), jittered(F.col("id"), F.col(c))).otherwise(F.col(c)).alias(c)
    found = propagated.filter("location_name is not null and lat is not null and lon is not null")
    return saved_locations(photos, exif, found.select("id", "location_name", at("lat"), at("lon")))


def got_or_created(table: DataFrame, names: DataFrame) -> DataFrame:
    """``table(id, name)`` with the ``names(name)`` that it lacks in any case, under ids after the largest in order of name. A name that is null or blank is an error."""
    wanted = names.select(F.trim("name").alias("name"), F.assert_true(F.coalesce(F.trim("name") != "", F.lit(False)), "a name is empty").alias("ok")).filter("ok is null")
    first = wanted.groupBy(F.lower("name").alias("low")).agg(F.min("name").alias("name"))
    new = first.join(table.select(F.lower("name").alias("low")), "low", "left_anti").select("name")
    start = table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return table.unionByName(with_ids(new, "name", start).select("id", "name"), allowMissingColumns=True)


def renamed(table: DataFrame, changes: DataFrame) -> DataFrame:
    """``table`` with names from ``changes(id, name)``; blank ones are an error."""
    good = F.assert_true(F.coalesce(F.trim("name") != "", F.lit(False)), "a name is empty")
    return upserted(table, changes.withColumn("_ok", good).filter("_ok is null").select("id", "name").join(table.select("id"), "id", "left_semi"), "id", ["name"])


def deleted(table: DataFrame, bridge: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows and bridge rows left once ``ids(id)`` are deleted."""
    return table.join(ids.select("id"), "id", "left_anti"), purged_rows(bridge, ids, key)


def added_to_albums(albums: DataFrame, bridge: DataFrame, additions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Albums and ``bridge(album_id, photo_id, position)`` with ``additions(album_id, photo_id, order)``: positions go on from the album's largest, photos already there stay where they are, and an album without a cover takes its first addition's."""
    first = additions.groupBy("album_id", "photo_id").agg(F.min("order").alias("order"))
    fresh = first.join(bridge.select("album_id", "photo_id"), ["album_id", "photo_id"], "left_anti")
    most = bridge.groupBy("album_id").agg(F.max("position").alias("most"))
    rank = F.row_number().over(Window.partitionBy("album_id").orderBy("order", "photo_id"))
    placed = fresh.join(most, "album_id", "left").select("album_id", "photo_id", (F.coalesce("most", F.lit(0)) + rank).cast(bridge.schema["position"].dataType).alias("position"))
    cover = first.groupBy(F.col("album_id").alias("id")).agg(F.min_by("photo_id", F.struct("order", "photo_id")).alias("_first"))
    out = albums.join(cover, "id", "left").withColumn("cover_photo_id", F.coalesce("cover_photo_id", "_first")).drop("_first")
    return out, bridge.unionByName(placed)


def removed_from_people(people: DataFrame, bridge: DataFrame, removals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """People and bridge without ``removals(person_id, photo_id)``; a cover that is removed gives way to the person's least photo left, or null."""
    left = bridge.join(removals, ["person_id", "photo_id"], "left_anti")
    lost = removals.select(F.col("person_id").alias("id"), F.col("photo_id").alias("cover_photo_id"), F.lit(True).alias("_lost")).distinct()
    next_ = left.groupBy(F.col("person_id").alias("id")).agg(F.min("photo_id").alias("_next"))
    out = people.join(lost, ["id", "cover_photo_id"], "left").join(next_, "id", "left")
    return out.withColumn("cover_photo_id", F.when(F.col("_lost"), F.col("_next")).otherwise(F.col("cover_photo_id"))).drop("_lost", "_next"), left


def missing_thumbnails(photos: DataFrame) -> DataFrame:
    """Photos without a thumbnail."""
    return photos.filter(F.coalesce("thumbnail_path", F.lit("")) == "")


def audit_filter(audit: DataFrame, status: str = "all", text: str = "") -> DataFrame:
    """Rows of ``audit(filename, target_folder, category, status)`` that are matched or have issues, with a text in any of their names."""
    matched = F.col("status") == "matched"
    out = audit if status == "all" else audit.filter(matched if status == "matched" else ~matched)
    q = F.lit(text.strip().lower())
    said = [F.contains(F.lower(F.coalesce(c, F.lit(""))), q) for c in ("filename", "target_folder", "category")]
    return out.filter(said[0] | said[1] | said[2]) if text.strip() else out


def group_filter(groups: DataFrame, tab: str = "all", least: int = 0, text: str = "", members: DataFrame | None = None) -> DataFrame:
    """Duplicate groups of a tab (all, exact, similar, videos) and confidence; a text, among names and paths of ``members(group_id, filename, file_path)``, counts on the tab of all only."""
    out = groups.filter(F.col("confidence") >= least)
    tabs = {"exact": F.col("is_exact"), "similar": ~F.col("is_exact"), "videos": F.col("is_video")}
    if tab in tabs:
        return out.filter(tabs[tab])
    q = text.strip().lower()
    if not q or members is None:
        return out
    said = F.contains(F.lower("filename"), F.lit(q)) | F.contains(F.lower(F.coalesce("file_path", F.lit(""))), F.lit(q))
    return out.join(members.filter(said).select("group_id").distinct(), "group_id", "left_semi")


def tab_counts(groups: DataFrame) -> DataFrame:
    """Groups of each tab, one row."""
    return groups.agg(F.count("*").alias("all"), F.count_if("is_exact").alias("exact"), F.count_if(~F.col("is_exact")).alias("similar"), F.count_if("is_video").alias("videos"))


def sort_groups(groups: DataFrame, by: str = "size") -> DataFrame:
    """Groups by what they free, their confidence or their members, largest first, ties by id."""
    return groups.orderBy(F.desc({"size": "recoverable_bytes", "confidence": "confidence", "count": "n"}[by]), "group_id")


def sort_people(people: DataFrame, by: str = "recent") -> DataFrame:
    """``people(id, name, n, latest)`` by their latest photo, their photos or their names, ties by id."""
    order = {"recent": F.desc_nulls_last("latest"), "count": F.desc("n"), "name": F.lower("name")}[by]
    return people.orderBy(order, "id")


def resolved_names(plan: DataFrame, existing: DataFrame, strategy: str = "rename") -> DataFrame:
    """``plan(id, folder, name)`` with ``new_name`` by a strategy: rename (``organize.free_names``), overwrite (the name itself), or skip (null for a name that is there, or that an earlier file of the plan takes)."""
    from shutterlake.operators.organize import free_names

    if strategy == "rename":
        return free_names(plan, existing)
    if strategy == "overwrite":
        return plan.withColumn("new_name", F.col("name"))
    there = existing.select(F.col("folder"), F.lower("name").alias("_low")).distinct().withColumn("_there", F.lit(True))
    first = F.row_number().over(Window.partitionBy("folder", "_low").orderBy("id")) == 1
    out = plan.withColumn("_low", F.lower("name")).join(there, ["folder", "_low"], "left").withColumn("_first", first)
    return out.withColumn("new_name", F.when(F.col("_there").isNull() & F.col("_first"), F.col("name"))).select(*plan.columns, "new_name")


def move_totals(moves: DataFrame) -> DataFrame:
    """Files and bytes of ``moves(path, new_path, file_size)``, those that stay where they are left out: one row."""
    return moves.filter("path <> new_path").agg(F.count("*").alias("n"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("n_bytes"))


def undone(runs: DataFrame, moves: DataFrame, run_id: str) -> DataFrame:
    """The moves of ``run_id`` with their paths exchanged. ``runs(run_id, undone)``; a run that is unknown or undone already is an error."""
    state = runs.filter(F.col("run_id") == run_id).agg(F.count("*").alias("n"), F.bool_or("undone").alias("undone")).first()
    if not state.n or state.undone:
        raise ValueError(f"run {run_id} is {'undone already' if state.n else 'unknown'}")
    return moves.filter(F.col("run_id") == run_id).select("run_id", F.col("new_path").alias("path"), F.col("path").alias("new_path"))
