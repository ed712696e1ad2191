"""Catalogue queries: filters, joins, aggregates, windows, ordering, sync and updates, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.functions import scalars as K
from shutterlake.operators import catalogue as op
from shutterlake.operators import summaries
from shutterlake.plans.views import Catalog, duckdb_sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    """Registers a function of a catalogue under a name with its SQL."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        ORACLES[name] = duckdb_sql(sql)
        return f

    return put


LIVE = "NOT is_trashed"


@query("a1_timeline", "SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM {photos} WHERE NOT is_trashed AND NOT is_archived GROUP BY 1")
def _(c):
    return op.timeline(c.photos)


@query("a1_timeline_with_archive", "SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM {photos} WHERE NOT is_trashed GROUP BY 1")
def _(c):
    return op.timeline(c.photos, archived=True)


@query("a2_stats", "SELECT count(*) FILTER (NOT is_trashed) AS n_photos, CAST(sum(file_size) FILTER (NOT is_trashed) AS BIGINT) AS n_bytes, count(*) FILTER (NOT is_trashed AND is_favorite) AS n_favorites, (SELECT count(*) FROM {albums}) AS n_albums FROM {photos}")
def _(c):
    return op.stats(c.photos, c.albums)


@query("a3_photo_count", "SELECT count(*) FILTER (NOT is_trashed) AS n, count(*) FILTER (is_trashed) AS n_trashed, count(*) FILTER (NOT is_trashed AND is_favorite) AS n_favorites FROM {photos}")
def _(c):
    live = ~F.col("is_trashed")
    return c.photos.agg(F.count_if(live).alias("n"), F.count_if("is_trashed").alias("n_trashed"), F.count_if(live & F.col("is_favorite")).alias("n_favorites"))


@query("a4_albums", "SELECT a.id, a.name, count(p.photo_id) AS n, any_value(t.filename) AS cover FROM {albums} a LEFT JOIN {album_photos} p ON p.album_id = a.id LEFT JOIN {photos} t ON t.id = a.cover_photo_id GROUP BY a.id, a.name")
def _(c):
    covers = c.photos.select(F.col("id").alias("cover_photo_id"), F.col("filename").alias("cover"))
    return op.counted(c.albums, c.album_photos, "album_id").join(covers, "cover_photo_id", "left").select("id", "name", "n", "cover")


@query("a5_people", "SELECT p.id, p.name, p.is_favorite, count(t.id) AS n FROM {people} p LEFT JOIN {photo_people} pp ON pp.person_id = p.id LEFT JOIN {photos} t ON t.id = pp.photo_id AND NOT t.is_trashed GROUP BY ALL")
def _(c):
    return op.counted(c.people, c.photo_people, "person_id", c.photos).select("id", "name", "is_favorite", "n").orderBy(F.desc("is_favorite"), F.desc("n"), "name", "id")


@query("a6_tags", "SELECT t.id, t.name, count(b.photo_id) AS n FROM {tags} t LEFT JOIN {photo_tags} b ON b.tag_id = t.id GROUP BY ALL")
def _(c):
    return op.counted(c.tags, c.photo_tags, "tag_id").orderBy("name")


@query("a7_years_and_bytes", "SELECT CAST(year(created_at) AS INTEGER) AS year, count(*) AS n, CAST(sum(file_size) AS BIGINT) AS n_bytes FROM {photos} WHERE NOT is_trashed GROUP BY 1")
def _(c):
    return c.photos.filter(LIVE).groupBy(F.year("created_at").alias("year")).agg(F.count("*").alias("n"), F.sum("file_size").alias("n_bytes"))


@query("a8_category_counts", "SELECT coalesce(document_category, 'All') AS category, count(*) AS n FROM {photos} WHERE is_document AND NOT is_trashed GROUP BY ROLLUP (document_category)")
def _(c):
    return c.photos.filter("is_document and not is_trashed").rollup("document_category").agg(F.count("*").alias("n")).select(F.coalesce("document_category", F.lit("All")).alias("category"), "n")


@query("a11_location_groups", "SELECT location_name || ' (' || CAST(year(created_at) AS VARCHAR) || ')' AS place, count(*) AS n FROM {photos} WHERE NOT is_trashed AND location_name <> '' GROUP BY 1")
def _(c):
    place = F.concat("location_name", F.lit(" ("), F.year("created_at").cast("string"), F.lit(")"))
    return c.photos.filter("not is_trashed and location_name <> ''").groupBy(place.alias("place")).agg(F.count("*").alias("n"))


@query("a12_geo_cells", "SELECT count(*) AS n FROM (SELECT DISTINCT CAST(round(gps_lat * 1000) AS BIGINT), CAST(round(gps_lon * 1000) AS BIGINT) FROM {exif} e JOIN {photos} p ON p.id = e.photo_id WHERE NOT is_trashed AND gps_lat IS NOT NULL)")
def _(c):
    geo = c.photos.filter(LIVE).join(c.exif.filter("gps_lat is not null and gps_lon is not null"), F.col("id") == F.col("photo_id"))
    return geo.select(F.round(F.col("gps_lat") * 1000).cast("long"), F.round(F.col("gps_lon") * 1000).cast("long")).distinct().agg(F.count("*").alias("n"))


CELLS = "CAST(round(gps_lat * 1000) AS BIGINT), CAST(round(gps_lon * 1000) AS BIGINT)"


@query("a12_cell_sketches", f"SELECT CAST(year(created_at) AS INTEGER) AS year, count(DISTINCT ({CELLS})) AS n, true AS close FROM {{exif}} e JOIN {{photos}} p ON p.id = e.photo_id WHERE NOT is_trashed AND gps_lat IS NOT NULL GROUP BY 1")
def _(c):
    """Cells a year from sketches a month, merged, beside the exact count: within 6 standard errors of it."""
    geo = c.photos.filter(LIVE).join(c.exif.filter("gps_lat is not null and gps_lon is not null"), F.col("id") == F.col("photo_id"))
    cell = [F.round(F.col(x) * 1000).cast("long") for x in ("gps_lat", "gps_lon")]
    rows = geo.select(F.year("created_at").alias("year"), F.month("created_at").alias("month"), *[x.alias(n) for x, n in zip(cell, ("lat", "lon"), strict=True)])
    guess = summaries.distinct_of(summaries.distinct_sketches(rows, ["year", "month"], F.col("lat"), F.col("lon")), ["year"]).withColumnRenamed("n", "guess")
    exact = rows.groupBy("year").agg(F.count_distinct("lat", "lon").alias("n"))
    return exact.join(guess, "year").select("year", "n", (F.abs(F.col("guess") - F.col("n")) <= F.col("n") * 6 * 1.04 / 64).alias("close"))


@query("a13_place_groups", "SELECT location_name, count(*) AS n, arg_min(id, (created_at, id)) AS first_id FROM {photos} WHERE NOT is_trashed AND location_name <> '' GROUP BY 1")
def _(c):
    return c.photos.filter("not is_trashed and location_name <> ''").groupBy("location_name").agg(F.count("*").alias("n"), F.min_by("id", F.struct("created_at", "id")).alias("first_id"))


@query("a15_quick_duplicates", """SELECT count(*) AS n_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_redundant, CAST(coalesce(sum(freed), 0) AS BIGINT) AS freed FROM (
  SELECT count(*) AS n, sum(file_size) - max(file_size) AS freed FROM {photos} WHERE NOT is_trashed AND file_size > 0
  GROUP BY CASE WHEN length(perceptual_hash) = 64 AND perceptual_hash <> repeat('0', 64) THEN 'hash_' || perceptual_hash ELSE 'dim_' || file_size || '_' || width || '_' || height END HAVING count(*) > 1)""")
def _(c):
    return op.quick_duplicates(c.photos)


@query("a17_recoverable_junk", """SELECT CAST(sum(file_size) FILTER (blur_score >= 0 AND blur_score < 100) AS BIGINT) AS blurry_bytes,
  (SELECT CAST(coalesce(sum(file_size), 0) AS BIGINT) FROM (SELECT file_size, row_number() OVER (PARTITION BY perceptual_hash ORDER BY id) AS k FROM {photos} WHERE perceptual_hash <> '' AND NOT is_trashed) WHERE k > 1) AS copy_bytes FROM {photos} WHERE NOT is_trashed""")
def _(c):
    live = c.photos.filter(LIVE)
    copies = op.later_copies(live, "perceptual_hash").agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("copy_bytes"))
    return live.agg(F.sum(F.when((F.col("blur_score") >= 0) & (F.col("blur_score") < 100), F.col("file_size"))).alias("blurry_bytes")).crossJoin(copies)


@query("a18_organizer_counts", """SELECT count(*) AS n, count(*) FILTER (is_document) AS documents, count(*) FILTER (mime_type LIKE 'video/%') AS videos, count(*) FILTER (is_favorite) AS favorites,
  count(*) FILTER (location_name <> '' AND location_name <> 'Unknown Location') AS places, count(*) FILTER (NOT faces_scanned) AS unscanned_faces, count(*) FILTER (extracted_text IN ('', 'ERROR') AND NOT mime_type LIKE 'video/%') AS unscanned_text FROM {photos} WHERE NOT is_trashed""")
def _(c):
    n = lambda cond, name: F.count_if(cond).alias(name)
    place = F.col("location_name")
    return c.photos.filter(LIVE).agg(
        F.count("*").alias("n"), n(F.col("is_document"), "documents"), n(op.is_video(), "videos"), n(F.col("is_favorite"), "favorites"), n((place != "") & (place != "Unknown Location"), "places"),
        n(~F.col("faces_scanned"), "unscanned_faces"), n(F.col("extracted_text").isin("", "ERROR") & ~op.is_video(), "unscanned_text"))


@query("a19_date_groups", "SELECT CAST(created_at AS DATE)::VARCHAR AS day, id, row_number() OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY id) AS rank FROM {photos}")
def _(c):
    return op.date_groups(c.photos)


@query("a20_person_span", "SELECT person_id, CAST(min(year(created_at)) AS VARCHAR) || '-' || CAST(max(year(created_at)) AS VARCHAR) AS span, count(*) AS n FROM {photo_people} b JOIN {photos} p ON p.id = b.photo_id GROUP BY 1")
def _(c):
    y = F.year("created_at")
    return c.photo_people.join(c.photos.select(F.col("id").alias("photo_id"), "created_at"), "photo_id").groupBy("person_id").agg(F.concat_ws("-", F.min(y).cast("string"), F.max(y).cast("string")).alias("span"), F.count("*").alias("n"))


@query("a21_score_summary", "SELECT count(blur_score) AS n, round(min(blur_score), 1) AS least, round(max(blur_score), 1) AS most, round(avg(blur_score), 1) AS mean, round(median(blur_score), 1) AS median, round(stddev_pop(blur_score), 1) AS deviation FROM {photos}")
def _(c):
    return op.score_summary(c.photos, "blur_score")


@query("a21_quantile_sketches", "SELECT is_document, count(*) AS n, true AS close FROM {photos} WHERE blur_score IS NOT NULL GROUP BY 1")
def _(c):
    """Quartiles of scores from sketches, those of even ids added to those of odd ones: their ranks among all scores are within 2 % of all rows."""
    half = [summaries.quantile_sketches(c.photos.filter(f"id % 2 = {k}"), ["is_document"], F.col("blur_score")) for k in (0, 1)]
    found = summaries.quantiles_of(summaries.added(*half, ["is_document"]), ["is_document"], [0.25, 0.5, 0.75])
    rows = c.photos.filter("blur_score is not null").select("is_document", "blur_score").join(F.broadcast(found.select("is_document", "quantiles")), "is_document")  # a row a kind
    ok = F.lit(True)
    for i, share in enumerate((0.25, 0.5, 0.75)):
        q = F.get("quantiles", F.lit(i))
        ok = ok & (F.avg((F.col("blur_score") < q).cast("double")) <= share + 0.02) & (F.avg((F.col("blur_score") <= q).cast("double")) >= share - 0.02)
    return rows.groupBy("is_document").agg(F.count("*").alias("n"), ok.alias("close"))


SWEEP = list(range(20, 71, 5))


@query("a22_threshold_metrics", f"""WITH x AS (SELECT blur_score / 4 AS score, is_favorite AS truth, unnest({SWEEP}) AS threshold FROM {{photos}}),
c AS (SELECT threshold, count(*) FILTER (score >= threshold AND truth) AS tp, count(*) FILTER (score >= threshold AND NOT truth) AS fp, count(*) FILTER (score < threshold AND NOT truth) AS tn, count(*) FILTER (score < threshold AND truth) AS fn FROM x GROUP BY 1)
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, (tp + tn) / (tp + fp + tn + fn) AS accuracy FROM c""")
def _(c):
    return op.threshold_metrics(c.photos.select((F.col("blur_score") / 4).alias("score"), F.col("is_favorite").alias("truth")), "score", "truth", SWEEP)


@query("a23_blur_rates", "SELECT is_document, round(avg(CASE WHEN blur_score >= 0 AND blur_score < 120 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM {photos} GROUP BY 1")
def _(c):
    return c.photos.groupBy("is_document").agg(F.round(F.avg(F.when((F.col("blur_score") >= 0) & (F.col("blur_score") < 120), 1.0).otherwise(0.0)), 6).alias("rate"))


@query("a24_table_health", """SELECT 'photo id repeated' AS rule, count(*) AS n FROM (SELECT id FROM {photos} GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'file path repeated', count(*) FROM (SELECT file_path FROM {photos} GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'file path missing', count(*) FROM {photos} WHERE file_path IS NULL OR file_path = '' UNION ALL SELECT 'exif without photo', count(*) FROM {exif} WHERE photo_id NOT IN (SELECT id FROM {photos}) UNION ALL SELECT 'person without photo', count(*) FROM {photo_people} WHERE photo_id NOT IN (SELECT id FROM {photos})""")
def _(c):
    return op.table_health(c.photos, c.exif, c.photo_people)


@query("f1_photos", "SELECT p.id, p.filename, p.created_at, e.make, e.gps_lat FROM {photos} p LEFT JOIN {exif} e ON e.photo_id = p.id WHERE NOT is_locked AND NOT is_trashed AND NOT is_archived")
def _(c):
    return op.filtered_photos(c.photos, c.exif, op.PhotoFilter()).select("id", "filename", "created_at", "make", "gps_lat")


@query("f1_photos_searched", "SELECT p.id, e.make FROM {photos} p LEFT JOIN {exif} e ON e.photo_id = p.id WHERE NOT is_locked AND NOT is_trashed AND NOT is_archived AND (filename ILIKE '%scan%' OR description ILIKE '%scan%' OR location_name ILIKE '%scan%' OR extracted_text ILIKE '%scan%' OR model ILIKE '%scan%' OR make ILIKE '%scan%' OR EXISTS (SELECT 1 FROM {photo_people} b JOIN {people} x ON x.id = b.person_id WHERE b.photo_id = p.id AND x.name ILIKE '%scan%'))")
def _(c):
    return op.filtered_photos(c.photos, c.exif, op.PhotoFilter(search="scan"), photo_people=c.photo_people, people=c.people).select("id", "make")


@query("f1_favorites_in_trash", "SELECT p.id, e.model FROM {photos} p LEFT JOIN {exif} e ON e.photo_id = p.id WHERE NOT is_locked AND is_trashed AND is_favorite")
def _(c):
    return op.filtered_photos(c.photos, c.exif, op.PhotoFilter(trashed=True, favorite=True)).select("id", "model")


@query("f2_search", """SELECT id FROM {photos} p LEFT JOIN {exif} e ON e.photo_id = p.id WHERE filename ILIKE '%canon%' OR description ILIKE '%canon%' OR location_name ILIKE '%canon%' OR extracted_text ILIKE '%canon%' OR model ILIKE '%canon%' OR make ILIKE '%canon%'
  OR EXISTS (SELECT 1 FROM {photo_people} b JOIN {people} x ON x.id = b.person_id WHERE b.photo_id = p.id AND x.name ILIKE '%canon%')""")
def _(c):
    return op.search_ids(c.photos, c.exif, c.photo_people, c.people, "canon")


@query("f2_search_people", "SELECT DISTINCT b.photo_id AS id FROM {photo_people} b JOIN {people} x ON x.id = b.person_id WHERE x.name ILIKE '%#000000001%'")
def _(c):
    return op.search_ids(c.photos, c.exif, c.photo_people, c.people, "#000000001")


@query("f3_geo_photos", "SELECT id, gps_lat, gps_lon FROM {photos} p JOIN {exif} e ON e.photo_id = p.id WHERE gps_lat IS NOT NULL AND gps_lon IS NOT NULL AND NOT is_trashed")
def _(c):
    return c.photos.filter(LIVE).join(c.exif.filter("gps_lat is not null and gps_lon is not null"), F.col("id") == F.col("photo_id")).select("id", "gps_lat", "gps_lon")


@query("f4_photos_by_id", "SELECT id, filename FROM {photos} WHERE id IN (SELECT cover_photo_id FROM {people})")
def _(c):
    return c.photos.join(c.people.select(F.col("cover_photo_id").alias("id")), "id", "left_semi").select("id", "filename")


@query("f4_exif_by_id", "SELECT photo_id, make, model, gps_lat, gps_lon FROM {exif} WHERE photo_id IN (SELECT cover_photo_id FROM {people}) AND photo_id IN (SELECT id FROM {photos})")
def _(c):
    return op.exif_by_id(c.exif, c.photos, c.people.select(F.col("cover_photo_id").alias("id")))


@query("f5_unanalyzed", "SELECT id FROM {photos} WHERE blur_score = -1 OR perceptual_hash = '' OR perceptual_hash IS NULL")
def _(c):
    return c.photos.filter("blur_score = -1 or coalesce(perceptual_hash, '') = ''").select("id")


@query("f6_unscanned_documents", "SELECT id FROM {photos} WHERE mime_type LIKE 'image/%' AND extracted_text IN ('', 'ERROR') AND NOT is_trashed")
def _(c):
    return c.photos.filter("mime_type like 'image/%' and extracted_text in ('', 'ERROR') and not is_trashed").select("id")


@query("f7_unscanned_faces", "SELECT id FROM {photos} WHERE NOT faces_scanned AND NOT is_trashed ORDER BY created_at DESC, id DESC LIMIT 500")
def _(c):
    return c.photos.filter("not faces_scanned and not is_trashed").orderBy(F.desc("created_at"), F.desc("id")).limit(500).select("id")


@query("f8_missing_location", "SELECT id, gps_lat FROM {photos} p LEFT JOIN {exif} e ON e.photo_id = p.id WHERE NOT is_trashed AND (location_name IS NULL OR location_name IN ('', 'Unknown Location'))")
def _(c):
    return c.photos.filter("not is_trashed and (location_name is null or location_name in ('', 'Unknown Location'))").join(c.exif, F.col("id") == F.col("photo_id"), "left").select("id", "gps_lat")


@query("f8_location_input", "SELECT id, created_at, gps_lat, gps_lon FROM {photos} p LEFT JOIN {exif} e ON e.photo_id = p.id WHERE NOT is_trashed")
def _(c):
    return op.location_input(c.photos, c.exif).select("id", "created_at", "gps_lat", "gps_lon")


@query("f9_unfingerprinted", "SELECT id FROM {photos} p LEFT JOIN {fingerprints} f ON f.photo_id = p.id WHERE NOT is_trashed AND (f.photo_id IS NULL OR dhash = '')")
def _(c):
    done = c.fingerprints.filter("dhash <> ''").select(F.col("photo_id").alias("id"))
    return c.photos.filter(LIVE).join(done, "id", "left_anti").select("id")


@query("f11_large_files", "SELECT id, file_size FROM {photos} WHERE file_size >= 10485760 AND mime_type LIKE 'video/%' AND NOT is_trashed")
def _(c):
    return op.large_files(c.photos, 10 * op.MB, "video").select("id", "file_size")


@query("f12_videos_and_favorites", "SELECT id, mime_type LIKE 'video/%' AS video, is_favorite FROM {photos} WHERE NOT is_trashed AND (mime_type LIKE 'video/%' OR is_favorite)")
def _(c):
    return c.photos.filter(~F.col("is_trashed") & (op.is_video() | F.col("is_favorite"))).select("id", op.is_video().alias("video"), "is_favorite")


@query("f13_blurry", "SELECT id, blur_score FROM {photos} WHERE blur_score >= 0 AND blur_score < 100 AND NOT is_trashed")
def _(c):
    return c.photos.filter("blur_score >= 0 and blur_score < 100 and not is_trashed").select("id", "blur_score").orderBy("blur_score", "id")


@query("f14_whatsapp_like", "SELECT id FROM {photos} WHERE contains(upper(filename), 'WA')")
def _(c):
    return c.photos.filter(F.contains(F.upper("filename"), F.lit("WA"))).select("id")


@query("f15_document_view", "SELECT id FROM {photos} WHERE NOT is_trashed AND (is_document OR regexp_matches(mime_type, 'pdf|text|document')) AND document_category = 'Invoices'")
def _(c):
    return c.photos.filter(~F.col("is_trashed") & (F.col("is_document") | F.col("mime_type").rlike("pdf|text|document")) & (F.col("document_category") == "Invoices")).select("id")


@query("f16_stale_locations", "SELECT id, CASE WHEN e.gps_lat IS NULL OR e.gps_lon IS NULL THEN NULL ELSE location_name END AS location_name FROM {photos} p LEFT JOIN {exif} e ON e.photo_id = p.id")
def _(c):
    located = c.exif.filter("gps_lat is not null and gps_lon is not null").select(F.col("photo_id").alias("id"), F.lit(True).alias("ok"))
    return c.photos.join(located, "id", "left").select("id", F.when(F.col("ok"), F.col("location_name")).alias("location_name"))


@query("f17_memories", """WITH l AS (SELECT * FROM {photos} WHERE NOT is_trashed), f AS (SELECT id, count(*) OVER () AS a FROM l WHERE is_favorite), h AS (SELECT id, count(*) OVER () AS a FROM (SELECT id FROM l ORDER BY created_at DESC, id DESC LIMIT 10))
SELECT 'last_year' AS kind, id FROM l WHERE year(created_at) = 1997 AND month(created_at) = 8 UNION ALL SELECT 'favorites', id FROM f WHERE a >= 2 UNION ALL SELECT 'highlights', id FROM h WHERE a >= 3""")
def _(c):
    return op.memories(c.photos, F.lit("1998-08-15 12:00:00").cast("timestamp"))


@query("j1_album_photos", "SELECT p.id, b.album_id, b.position FROM {photos} p JOIN {album_photos} b ON b.photo_id = p.id WHERE NOT is_trashed")
def _(c):
    return op.through(c.photos, c.album_photos, "album_id").select("id", "album_id", "position")


@query("j2_photos_by_person", "SELECT p.id, b.person_id FROM {photos} p JOIN {photo_people} b ON b.photo_id = p.id WHERE NOT is_trashed")
def _(c):
    return op.through(c.photos, c.photo_people, "person_id").select("id", "person_id")


@query("j2_tags_for_photo", "SELECT p.id, t.name FROM {photos} p JOIN {photo_tags} b ON b.photo_id = p.id JOIN {tags} t ON t.id = b.tag_id WHERE NOT is_trashed")
def _(c):
    return op.through(c.photos, c.photo_tags, "tag_id").select("id", "tag_id").join(c.tags.withColumnRenamed("id", "tag_id"), "tag_id").select("id", "name")


@query("j3_tagged_photos", "SELECT id FROM {photos} WHERE NOT is_trashed AND id IN (SELECT photo_id FROM {photo_tags})")
def _(c):
    return c.photos.filter(LIVE).join(c.photo_tags.select(F.col("photo_id").alias("id")), "id", "left_semi").select("id")


@query("j4_orphans", """SELECT 'bridge' AS kind, count(*) AS n FROM {photo_people} WHERE photo_id NOT IN (SELECT id FROM {photos}) UNION ALL SELECT 'people', count(*) FROM {people} WHERE id NOT IN (SELECT person_id FROM {photo_people})
UNION ALL SELECT 'photos', count(*) FROM {photos} WHERE source_folder_path NOT IN (SELECT folder_path FROM {folders})""")
def _(c):
    return op.orphans(c.photos, c.photo_people, c.people, c.folders)


@query("j5_folder_counts", "SELECT f.folder_path, count(p.id) AS n FROM (SELECT folder_path FROM {folders} UNION SELECT '/lib') f LEFT JOIN {photos} p ON NOT p.is_trashed AND (p.source_folder_path = f.folder_path OR starts_with(p.source_folder_path, f.folder_path || '/')) GROUP BY 1")
def _(c):
    return op.folder_counts(c.photos, c.folders.select("folder_path").union(c.spark.sql("select '/lib'")))


@query("j11_person_names", "SELECT b.photo_id, string_agg(x.name, ' & ' ORDER BY x.name, x.id) AS names FROM {photo_people} b JOIN {people} x ON x.id = b.person_id WHERE x.name <> 'Unknown Person' GROUP BY 1")
def _(c):
    named = c.photo_people.join(c.people.filter("name <> 'Unknown Person'").select(F.col("id").alias("person_id"), "name"), "person_id")
    return named.groupBy("photo_id").agg(F.array_sort(F.collect_list(F.struct("name", "person_id"))).alias("x")).select("photo_id", F.array_join(F.transform("x", lambda y: y["name"]), " & ").alias("names"))


@query("w1_sessions", """WITH g AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS p FROM events)
SELECT event_id, CAST(sum(CASE WHEN p IS NULL OR epoch(date_trunc('second', ts)) - epoch(date_trunc('second', p)) > 12600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS BIGINT) AS session FROM g""")
def _(c):
    return op.sessions(c.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["user_id"], tie="event_id").select("event_id", "session")


@query("w2_trip_windows", """WITH d AS (SELECT location_name, CAST(created_at AS DATE) AS day, count(*) AS n FROM {photos} WHERE location_name NOT IN ('', 'Unknown Location') AND NOT is_trashed GROUP BY 1, 2),
g AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY location_name ORDER BY day) <= 2 THEN 0 ELSE 1 END AS new FROM d), t AS (SELECT *, CAST(sum(new) OVER (PARTITION BY location_name ORDER BY day) AS BIGINT) AS trip FROM g)
SELECT location_name, trip, min(day) AS first_day, max(day) AS last_day, CAST(year(min(day)) AS INTEGER) AS year, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY 1, 2""")
def _(c):
    return op.trip_windows(c.photos.filter(LIVE))


@query("w3_duplicate_copies", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY perceptual_hash ORDER BY id) AS k FROM {photos} WHERE perceptual_hash <> '') WHERE k > 1")
def _(c):
    return op.later_copies(c.photos, "perceptual_hash").select("id")


@query("w7_album_positions", """WITH a AS (SELECT DISTINCT tag_id % 25 AS album_id, photo_id FROM {photo_tags}), m AS (SELECT album_id, max(position) AS top FROM {album_photos} GROUP BY 1)
SELECT a.album_id, a.photo_id, m.top + row_number() OVER (PARTITION BY a.album_id ORDER BY a.photo_id) AS position FROM a JOIN m USING (album_id) WHERE NOT EXISTS (SELECT 1 FROM {album_photos} o WHERE o.album_id = a.album_id AND o.photo_id = a.photo_id)""")
def _(c):
    from pyspark.sql import Window

    added = c.photo_tags.select((F.col("tag_id") % 25).alias("album_id"), "photo_id").distinct().join(c.album_photos, ["album_id", "photo_id"], "left_anti")
    top = c.album_photos.groupBy("album_id").agg(F.max("position").alias("top"))
    return added.join(top, "album_id").select("album_id", "photo_id", (F.col("top") + F.row_number().over(Window.partitionBy("album_id").orderBy("photo_id"))).alias("position"))


@query("w8_samples_per_person", "SELECT person_id, photo_id, rank FROM (SELECT person_id, photo_id, row_number() OVER (PARTITION BY person_id ORDER BY created_at DESC, photo_id DESC) AS rank FROM {photo_people} b JOIN {photos} p ON p.id = b.photo_id) WHERE rank <= 3")
def _(c):
    dated = c.photo_people.join(c.photos.select(F.col("id").alias("photo_id"), "created_at"), "photo_id")
    return op.newest(dated, ["person_id"], [F.desc("created_at"), F.desc("photo_id")], 3).select("person_id", "photo_id", "rank")


@query("o1_deep_page", "SELECT id FROM {photos} WHERE NOT is_trashed ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 700")
def _(c):
    return c.photos.filter(LIVE).orderBy(F.desc("created_at"), F.desc("id")).offset(700).limit(100).select("id")


@query("o1_keyset_page", "SELECT id FROM {photos} WHERE NOT is_trashed ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 700")
def _(c):
    live = c.photos.filter(LIVE)
    return op.keyset_page(live, op.page_starts(live), 7).select("id")


@query("o2_sorted_people", "SELECT p.id, p.name, count(b.photo_id) AS n, max(t.created_at) AS latest FROM {people} p LEFT JOIN {photo_people} b ON b.person_id = p.id LEFT JOIN {photos} t ON t.id = b.photo_id WHERE p.name ILIKE '%supplier%' GROUP BY 1, 2")
def _(c):
    dated = c.photo_people.join(c.photos.select(F.col("id").alias("photo_id"), "created_at"), "photo_id", "left").groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("n"), F.max("created_at").alias("latest"))
    return c.people.filter(F.col("name").ilike("%supplier%")).join(dated, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n"), "latest").orderBy(F.desc_nulls_last("latest"), "id")


MEDIA = "NOT regexp_matches(lower(path), '[.]zip$')"


@query("x1_sync_diff", f"SELECT path, 'added' AS change FROM {{disk}} WHERE {MEDIA} AND path NOT IN (SELECT file_path FROM {{photos}}) UNION ALL SELECT file_path, 'removed' FROM {{photos}} WHERE file_path NOT IN (SELECT path FROM {{disk}})")
def _(c):
    return op.sync_diff(c.disk, c.photos)


@query("x2_sync_all", f"SELECT folder, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, change FROM (SELECT path, 'added' AS change FROM {{disk}} WHERE {MEDIA} AND path NOT IN (SELECT file_path FROM {{photos}}) UNION ALL SELECT file_path, 'removed' FROM {{photos}} WHERE file_path NOT IN (SELECT path FROM {{disk}}))) GROUP BY 1")
def _(c):
    return op.sync_diff(c.disk, c.photos).groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"))


@query("x3_union_paths", "SELECT path FROM {disk} UNION SELECT file_path FROM {photos}")
def _(c):
    return c.disk.select("path").unionByName(c.photos.select(F.col("file_path").alias("path"))).dropDuplicates(["path"])


@query("x4_sync_tags", "SELECT photo_id, tag_id FROM {photo_tags} WHERE photo_id % 7 <> 0 UNION SELECT p.id, t.id FROM {photos} p, {tags} t WHERE p.id % 7 = 0 AND t.id <= 2")
def _(c):
    want = c.photos.filter("id % 7 = 0").select(F.col("id").alias("photo_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("tag_id"))
    return c.photo_tags.join(want.select("photo_id").distinct(), "photo_id", "left_anti").unionByName(want.join(c.tags.select(F.col("id").alias("tag_id")), "tag_id", "left_semi"))


@query("x5_remove_folder", "SELECT 'photos' AS name, count(*) AS n FROM {photos} WHERE source_folder_path <> '/lib/c3' UNION ALL SELECT 'photo_people', count(*) FROM {photo_people} WHERE photo_id NOT IN (SELECT id FROM {photos} WHERE source_folder_path = '/lib/c3')")
def _(c):
    gone = op.folder_ancestors(c.photos.withColumn("is_trashed", F.lit(False))).filter("folder_path = '/lib/c3'").select("id")
    left, bridge, _ = op.purge(c.photos, c.photo_people, c.people, gone)
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return n(left, "photos").unionByName(n(bridge, "photo_people"))


@query("s6_upsert_photos", "SELECT file_path, source_folder_path FROM (SELECT file_path, CASE WHEN file_path IN (SELECT path FROM {disk}) THEN '/new' ELSE source_folder_path END AS source_folder_path FROM {photos}) UNION ALL SELECT DISTINCT path, '/new' FROM {disk} WHERE path NOT IN (SELECT file_path FROM {photos})")
def _(c):
    new = c.disk.select(F.col("path").alias("file_path"), F.lit("/new").alias("source_folder_path"))
    return op.upserted(c.photos.select("file_path", "source_folder_path"), new, "file_path", ["source_folder_path"])


@query("s7_upsert_exif", """SELECT photo_id, CASE WHEN photo_id % 3 = 0 THEN coalesce(CASE WHEN photo_id % 2 = 0 THEN 'Sony' END, make) ELSE make END AS make FROM {exif} UNION ALL SELECT id, CASE WHEN id % 2 = 0 THEN 'Sony' END FROM {photos} WHERE id % 3 = 0 AND id NOT IN (SELECT photo_id FROM {exif})""")
def _(c):
    new = c.photos.filter("id % 3 = 0").select(F.col("id").alias("photo_id"), F.when(F.col("id") % 2 == 0, "Sony").alias("make"))
    return op.upserted(c.exif.select("photo_id", "make"), new, "photo_id", ["make"])


@query("s8_upsert_fingerprints", "SELECT id, CASE WHEN f.video_duration IS NOT NULL THEN 'VID_DUR_' || CAST(CAST(round(f.video_duration) AS BIGINT) AS VARCHAR) || '_' || f.dhash WHEN f.dhash <> '' THEN f.dhash ELSE p.perceptual_hash END AS perceptual_hash FROM {photos} p LEFT JOIN {fingerprints} f ON f.photo_id = p.id")
def _(c):
    new = F.when(F.col("video_duration").isNotNull(), K.video_fingerprint(F.col("video_duration"), F.col("dhash"))).when(F.col("dhash") != "", F.col("dhash")).otherwise(F.col("perceptual_hash"))
    return c.photos.join(c.fingerprints.drop("base"), F.col("id") == F.col("photo_id"), "left").select("id", new.alias("perceptual_hash"))


#: What a store keeps of histograms and key frames: JSON text, some of it missing or broken.
KEPT = {
    "color_histogram": "CASE photo_id % 4 WHEN 0 THEN '[0.5, 0.25, ' || CAST(photo_id % 7 AS VARCHAR(9)) || ']' WHEN 1 THEN '{broken' END",
    "rgb_histogram": "CASE WHEN photo_id % 8 < 3 THEN '[1.0, 0.0]' END",
    "video_keyframes": """CASE WHEN video_duration IS NOT NULL THEN '["' || dhash || '", "00"]' END""",
}


@query("s9_stored_json", f"""WITH k AS (SELECT f.*, {', '.join(f'{e} AS {n}' for n, e in KEPT.items())} FROM {{fingerprints}} f)
SELECT id, nullif(sha256, '') AS sha256, coalesce(nullif(dhash, ''), nullif(perceptual_hash, '')) AS dhash, CASE WHEN json_valid(coalesce(color_histogram, rgb_histogram)) THEN list_sum(CAST(coalesce(color_histogram, rgb_histogram) AS JSON)::DOUBLE[]) END AS histogram_sum,
  CASE WHEN json_valid(coalesce(color_histogram, rgb_histogram)) THEN len(CAST(coalesce(color_histogram, rgb_histogram) AS JSON)::DOUBLE[]) END AS histogram_size, (CAST(video_keyframes AS JSON)::VARCHAR[])[1] AS first_frame
FROM {{photos}} p LEFT JOIN k ON k.photo_id = p.id WHERE NOT is_trashed""")
def _(c):
    rows = op.loaded_fingerprints(c.photos, c.fingerprints.drop("base").withColumns({n: F.expr(e) for n, e in KEPT.items()}))
    h = F.col("color_histogram")
    total = F.when(h.isNotNull(), F.aggregate(h, F.lit(0.0), lambda s, x: s + x))
    return rows.select("id", "sha256", "dhash", total.alias("histogram_sum"), F.when(h.isNotNull(), F.size(h)).cast("long").alias("histogram_size"), F.get("video_keyframes", F.lit(0)).alias("first_frame"))


@query("s9_load_fingerprints", "SELECT id, coalesce(nullif(dhash, ''), perceptual_hash) AS dhash, phash, sha256 FROM {photos} p LEFT JOIN {fingerprints} f ON f.photo_id = p.id WHERE NOT is_trashed")
def _(c):
    return c.photos.filter(LIVE).join(c.fingerprints.drop("base"), F.col("id") == F.col("photo_id"), "left").select("id", F.coalesce(F.nullif("dhash", F.lit("")), "perceptual_hash").alias("dhash"), "phash", "sha256")


@query("s10_missing_exif", "SELECT id FROM {photos} WHERE id NOT IN (SELECT photo_id FROM {exif}) ORDER BY id LIMIT 200")
def _(c):
    return c.photos.join(c.exif.select(F.col("photo_id").alias("id")), "id", "left_anti").select("id").orderBy("id").limit(200)


@query("u1_set_flag", "SELECT id, is_archived OR id IN (SELECT photo_id FROM {photo_tags} WHERE tag_id = 1) AS is_archived FROM {photos}")
def _(c):
    return op.set_flag(c.photos, c.photo_tags.filter("tag_id = 1").select(F.col("photo_id").alias("id")), "is_archived", True).select("id", "is_archived")


@query("u2_update_metadata", "SELECT id, CASE WHEN id % 5 = 0 THEN 'changed' ELSE description END AS description FROM {photos}")
def _(c):
    changes = c.photos.filter("id % 5 = 0").select("id", F.lit("changed").alias("description"))
    return op.upserted(c.photos.select("id", "description"), changes, "id", ["description"])


@query("u3_empty_trash", "WITH b AS (SELECT * FROM {photo_people} WHERE photo_id NOT IN (SELECT id FROM {photos} WHERE is_trashed)) SELECT 'photos' AS name, count(*) AS n FROM {photos} WHERE NOT is_trashed UNION ALL SELECT 'bridge', count(*) FROM b UNION ALL SELECT 'people', count(*) FROM {people} WHERE id IN (SELECT person_id FROM b)")
def _(c):
    left = op.purge(c.photos, c.photo_people, c.people, c.photos.filter("is_trashed").select("id"))
    n = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, df in zip(("photos", "bridge", "people"), left, strict=True)]
    return n[0].unionByName(n[1]).unionByName(n[2])


@query("u4_save_scan", "SELECT id, CASE WHEN id % 4 = 0 THEN CASE WHEN trim(CASE WHEN id % 8 = 0 THEN ' ' ELSE 'text' END) = '' THEN 'NONE' ELSE 'text' END ELSE extracted_text END AS extracted_text FROM {photos}")
def _(c):
    results = c.photos.filter("id % 4 = 0").select("id", F.when(F.col("id") % 8 == 0, " ").otherwise("text").alias("text"))
    blank = results.select("id", F.when(F.trim("text") == "", "NONE").otherwise(F.col("text")).alias("extracted_text"))
    return op.upserted(c.photos.select("id", "extracted_text"), blank, "id", ["extracted_text"])


@query("u7_merge_people", """WITH m AS (SELECT id AS old, id - id % 4 AS new FROM {people} WHERE id % 4 <> 0), t AS (SELECT p.*, coalesce(m.new, p.id) AS dest FROM {people} p LEFT JOIN m ON m.old = p.id)
SELECT dest AS id, coalesce(arg_min(name, (id <> dest, id)) FILTER (name <> 'Unknown Person'), 'Unknown Person') AS name, bool_or(is_favorite) AS is_favorite, any_value(b.n) AS n FROM t JOIN (
  SELECT coalesce(m.new, person_id) AS p, count(DISTINCT photo_id) AS n FROM {photo_people} LEFT JOIN m ON m.old = person_id GROUP BY 1) b ON b.p = dest GROUP BY 1""")
def _(c):
    merges = c.people.filter("id % 4 <> 0").select(F.col("id").alias("old"), (F.col("id") - F.col("id") % 4).alias("new"))
    people, bridge = op.merged_people(c.people, c.photo_people, merges)
    return people.select("id", "name", "is_favorite").join(bridge.groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("n")), "id")


def hamming_sql(a: str, b: str) -> str:
    """Bits that differ between two hex expressions of equal length, for DuckDB."""
    word = lambda x: f"CAST('0x' || substr({x}, i * 8 + 1, 8) AS BIGINT)"
    return f"CASE WHEN length({a}) > 0 AND length({a}) = length({b}) THEN CAST(list_sum([bit_count(xor({word(a)}, {word(b)})) for i in range(0, CAST(length({a}) / 8 AS BIGINT))]) AS INTEGER) ELSE 999 END"


@query("k1_hamming_hex", f"SELECT a.photo_id, {hamming_sql('a.dhash', 'b.dhash')} AS distance FROM {{fingerprints}} a JOIN {{fingerprints}} b ON b.photo_id = a.base")
def _(c):
    b = c.fingerprints.select(F.col("photo_id").alias("base"), F.col("dhash").alias("other"))
    return c.fingerprints.join(b, "base").select("photo_id", K.hamming_hex(F.col("dhash"), F.col("other")).alias("distance"))


@query("k2_match_percent", f"SELECT a.photo_id, CASE WHEN coalesce(length(a.phash), 0) = 0 OR coalesce(length(b.phash), 0) = 0 THEN 95 ELSE greatest(75, CAST(round(100.0 * (64 - {hamming_sql('a.phash', 'b.phash')}) / 64) AS INTEGER)) END AS percent FROM {{fingerprints}} a JOIN {{fingerprints}} b ON b.photo_id = a.base + 3")
def _(c):
    b = c.fingerprints.select((F.col("photo_id") - 3).alias("base"), F.col("phash").alias("other"))
    return c.fingerprints.join(b, "base").select("photo_id", K.match_percent(F.col("phash"), F.col("other")).alias("percent"))


@query("k3_k4_vectors", """SELECT a.id, round(greatest(0, least(1, list_sum([least(x[1], x[2])::DOUBLE for x in list_zip(a.descriptor, b.descriptor)]))), 5) AS overlap, round(sqrt(list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE) for x in list_zip(a.descriptor, b.descriptor)])), 5) AS distance
FROM {faces} a JOIN {faces} b ON b.id = a.id + 1""")
def _(c):
    b = c.faces.select((F.col("id") - 1).alias("id"), F.col("descriptor").alias("other"))
    d = lambda x: F.transform(x, lambda y: y.cast("double"))
    return c.faces.join(b, "id").select("id", F.round(K.histogram_similarity(d("descriptor"), d("other")), 5).alias("overlap"), F.round(K.euclidean(F.col("descriptor"), F.col("other")), 5).alias("distance"))


@query("k5_k6_names", r"""SELECT id, trim(regexp_replace(regexp_replace(lower(regexp_extract(file_path, '([^/\\]*)$', 1)), '\.[^.]*$', ''), '(\s*-\s*copy|\s*\(\d+\))+', '', 'g')) AS name, TRY_CAST(nullif(regexp_extract(filename, '([0-9]{4,})', 1), '') AS BIGINT) AS sequence, regexp_matches(lower(filename), '( - copy|\([0-9]+\))') AS is_copy FROM {photos}""".replace("{4,}", "[0-9][0-9][0-9][0-9]*").replace("[0-9][0-9][0-9][0-9][0-9]*", "[0-9][0-9][0-9][0-9]+"))
def _(c):
    return c.photos.select("id", K.clean_basename(F.col("file_path")).alias("name"), K.photo_sequence(F.col("filename")).alias("sequence"), K.is_copy_name(F.col("filename")).alias("is_copy"))


@query("k7_video_fingerprints", "SELECT photo_id, CAST(CAST(round(video_duration) AS BIGINT) AS DOUBLE) AS duration, dhash AS hash FROM {fingerprints} WHERE video_duration IS NOT NULL AND dhash <> ''")
def _(c):
    made = c.fingerprints.filter("video_duration is not null and dhash <> ''").select("photo_id", K.parse_video_fingerprint(K.video_fingerprint(F.col("video_duration"), F.col("dhash"))).alias("x"))
    return made.select("photo_id", "x.duration", "x.hash")


@query("k9_levenshtein", "SELECT s_suppkey AS id, levenshtein(s_name, 'Supplier#000000042') AS distance FROM supplier")
def _(c):
    return c.supplier.select(F.col("s_suppkey").alias("id"), F.levenshtein("s_name", F.lit("Supplier#000000042")).alias("distance"))


@query("k11_k13_k16_texts", r"""SELECT id, translate(filename, 'OoIl|SBZ', '00111582') AS digits, coalesce(nullif(trim(regexp_replace(location_name, '[<>:"/\\|?*]', '-', 'g')), ''), 'General') AS folder,
  regexp_matches(lower(filename), '[.]pdf$|invoice|receipt|scan|document|doc|bill|ticket|statement|certificate|passport|aadhaar|aadhar|license|licence|form|contract|agreement|letter|report|resume|prescription|pancard') AS document FROM {photos}""")
def _(c):
    return c.photos.select("id", K.normalize_digits(F.col("filename")).alias("digits"), K.sanitize_folder(F.col("location_name")).alias("folder"), K.has_document_filename(F.col("filename")).alias("document"))


@query("k14_format_date", """SELECT id, CASE date_diff('day', CAST(created_at AS DATE), DATE '1998-08-02') WHEN 0 THEN 'Today' WHEN 1 THEN 'Yesterday' ELSE monthname(created_at) || ' ' || CAST(day(created_at) AS VARCHAR) || ', ' || CAST(year(created_at) AS VARCHAR) END AS shown FROM {photos}""")
def _(c):
    return c.photos.select("id", K.format_date(F.col("created_at"), F.lit("1998-08-02").cast("date")).alias("shown"))


@query("k14_format_size", """SELECT id, CASE WHEN file_size <= 0 THEN '0 B' WHEN file_size < 1024 THEN printf('%.1f', file_size / 1.0) || ' B' WHEN file_size < 1048576 THEN printf('%.1f', round(file_size / 1024.0::DOUBLE, 1)) || ' KB' ELSE printf('%.1f', round(file_size / 1048576.0::DOUBLE, 1)) || ' MB' END AS size FROM {photos}""")
def _(c):
    return c.photos.select("id", K.format_size(F.col("file_size")).alias("size"))


@query("k17_k18_places", """SELECT photo_id, 'GPS (' || printf('%.2f', abs(gps_lat)) || CASE WHEN gps_lat >= 0 THEN '°N' ELSE '°S' END || ', ' || printf('%.2f', abs(gps_lon)) || CASE WHEN gps_lon >= 0 THEN '°E' ELSE '°W' END || ')' AS label, round(gps_lat + (photo_id % 97 - 48) / 80000.0::DOUBLE, 7) AS lat FROM {exif} WHERE gps_lat IS NOT NULL""")
def _(c):
    return c.exif.filter("gps_lat is not null").select("photo_id", K.gps_label(F.col("gps_lat"), F.col("gps_lon")).alias("label"), F.round(K.jittered(F.col("photo_id"), F.col("gps_lat")), 7).alias("lat"))


@query("s4_dms_to_decimal", "SELECT photo_id, round(floor(gps_lat) + floor((gps_lat - floor(gps_lat)) * 60) / 60, 6) AS lat FROM {exif} WHERE gps_lat IS NOT NULL")
def _(c):
    whole = F.floor("gps_lat").cast("double")
    dms = F.array(whole, F.floor((F.col("gps_lat") - whole) * 60).cast("double"), F.lit(0.0))
    return c.exif.filter("gps_lat is not null").select("photo_id", F.round(K.dms_to_decimal(dms, F.lit("N")), 6).alias("lat"))
