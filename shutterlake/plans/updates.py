"""Queries of changes, filters and orders of a catalogue, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.operators import catalogue as op
from shutterlake.operators import duplicates as dup
from shutterlake.operators import locations as loc
from shutterlake.operators import organize
from shutterlake.operators import updates as up
from shutterlake.plans.matching import ANCHORS, DAYS, NUMS, BEST, FP, GROUPS, KEYS, SCORE, TOTALS, placed, prints
from shutterlake.plans.library import CANDIDATES, candidates
from shutterlake.plans.views import Catalog, duckdb_sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql:
            ORACLES[name] = duckdb_sql(sql)
        return f

    return put


def counts(**frames):
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("u1_trash", "SELECT id, is_trashed OR id % 6 = 0 AS is_trashed, CASE WHEN id % 6 = 0 THEN '2024-05-06' END AS trashed_at FROM (SELECT id, CASE WHEN id % 4 = 0 THEN FALSE ELSE is_trashed END AS is_trashed FROM {photos})")
def _(c):
    ids = lambda n: c.photos.filter(F.col("id") % n == 0).select("id")
    back = up.trashed(c.photos, ids(4), False, F.lit("2020-01-01"))
    out = up.trashed(back, ids(6), True, F.lit("2024-05-06 00:00:00"))
    return out.select("id", "is_trashed", F.date_format("trashed_at", "yyyy-MM-dd").alias("trashed_at"))


@query("u3_purge_all", "WITH gone AS (SELECT id FROM {photos} WHERE id % 5 = 0) SELECT 'fingerprints' AS name, count(*) AS n FROM {fingerprints} WHERE photo_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'exif', count(*) FROM {exif} WHERE photo_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'photo_tags', count(*) FROM {photo_tags} WHERE photo_id NOT IN (SELECT id FROM gone)")
def _(c):
    ids = c.photos.filter("id % 5 = 0").select("id")
    return counts(fingerprints=up.purged_rows(c.fingerprints, ids), exif=up.purged_rows(c.exif, ids), photo_tags=up.purged_rows(c.photo_tags, ids))


@query("u4_save_results", """WITH r AS (SELECT id, CASE WHEN id % 8 = 0 THEN ' ' ELSE 'text' END AS t FROM {photos} WHERE id % 4 = 0)
SELECT p.id, CASE WHEN r.id IS NULL THEN extracted_text WHEN trim(t) = '' THEN 'NONE' ELSE t END AS extracted_text, CASE WHEN r.id IS NULL THEN is_document ELSE p.id % 3 = 0 END AS is_document, CASE WHEN r.id IS NULL THEN document_category WHEN p.id % 3 = 0 THEN 'Bills' END AS document_category,
  CASE WHEN p.id % 5 = 0 THEN CAST(p.id % 7 AS DOUBLE) ELSE blur_score END AS blur_score, CASE WHEN p.id % 9 = 0 THEN '/t/' || p.id END AS thumbnail_path FROM {photos} p LEFT JOIN r ON r.id = p.id""")
def _(c):
    i = F.col("id")
    scans = c.photos.filter("id % 4 = 0").select("id", F.when(i % 8 == 0, " ").otherwise("text").alias("extracted_text"), (i % 3 == 0).alias("is_document"), F.when(i % 3 == 0, "Bills").alias("document_category"))
    sharp = c.photos.filter("id % 5 = 0").select("id", (i % 7).cast("double").alias("blur_score"), "perceptual_hash")
    small = c.photos.filter("id % 9 = 0").select("id", F.concat(F.lit("/t/"), i.cast("string")).alias("thumbnail_path"), F.lit("").alias("preview_path"))
    out = up.saved_thumbnails(up.saved_analysis(up.saved_scan(c.photos, scans), sharp), small)
    return out.select("id", "extracted_text", "is_document", "document_category", "blur_score", "thumbnail_path")


@query("f10_missing_thumbnails", "SELECT id FROM {photos} WHERE id % 9 <> 0 OR id % 2 = 0")
def _(c):
    small = c.photos.filter("id % 9 = 0").select("id", F.when(F.col("id") % 2 == 1, "/t").otherwise("").alias("thumbnail_path"), F.lit("").alias("preview_path"))
    return up.missing_thumbnails(up.saved_thumbnails(c.photos, small)).select("id")


@query("u5_reset_scans", "SELECT FALSE AS faces_scanned, CAST(NULL AS VARCHAR) AS location_name, '' AS extracted_text, FALSE AS is_document, CAST(-1 AS DOUBLE) AS blur_score, '' AS perceptual_hash, count(*) AS n FROM {photos}")
def _(c):
    out = c.photos
    for kind in up.RESETS:
        out = up.reset_scan(out, kind)
    return out.groupBy("faces_scanned", "location_name", "extracted_text", "is_document", "blur_score", "perceptual_hash").agg(F.count("*").alias("n"))


NEW_TAGS = "SELECT CASE WHEN id % 3 = 0 THEN upper(name) WHEN id % 3 = 1 THEN 'new ' || name ELSE 'NEW ' || name END AS name FROM {tags}"


@query("u6_get_or_create_tags", f"WITH w AS (SELECT min(name) AS name FROM ({NEW_TAGS}) GROUP BY lower(name)), f AS (SELECT name FROM w WHERE lower(name) NOT IN (SELECT lower(name) FROM {{tags}})) SELECT id, name FROM {{tags}} UNION ALL SELECT (SELECT max(id) FROM {{tags}}) + row_number() OVER (ORDER BY name), name FROM f")
def _(c):
    i, name = F.col("id"), F.col("name")
    wanted = c.tags.select(F.when(i % 3 == 0, F.upper(name)).when(i % 3 == 1, F.concat(F.lit("new "), name)).otherwise(F.concat(F.lit("NEW "), name)).alias("name"))
    return up.got_or_created(c.tags.select("id", "name"), wanted)


@query("u6_rename_delete_people", "WITH left_ AS (SELECT id, CASE WHEN id % 7 = 1 THEN 'Person ' || id ELSE name END AS name FROM {people} WHERE id % 5 <> 0) SELECT l.id, l.name, count(b.photo_id) AS n FROM left_ l LEFT JOIN {photo_people} b ON b.person_id = l.id GROUP BY ALL")
def _(c):
    changes = c.people.filter("id % 7 = 1").select("id", F.concat(F.lit("Person "), F.col("id").cast("string")).alias("name"))
    left, bridge = up.deleted(up.renamed(c.people, changes), c.photo_people, c.people.filter("id % 5 = 0").select("id"), "person_id")
    return op.counted(left, bridge, "person_id").select("id", "name", "n")


@query("w7_add_to_albums", """WITH a AS (SELECT tag_id % 25 AS album_id, photo_id, min(photo_id * 7 % 1000) AS o FROM {photo_tags} GROUP BY ALL), f AS (SELECT * FROM a WHERE (album_id, photo_id) NOT IN (SELECT (album_id, photo_id) FROM {album_photos})),
m AS (SELECT album_id, max(position) AS m FROM {album_photos} GROUP BY 1) SELECT album_id, photo_id, position FROM {album_photos} UNION ALL SELECT f.album_id, photo_id, coalesce(m, 0) + row_number() OVER (PARTITION BY f.album_id ORDER BY o, photo_id) FROM f LEFT JOIN m ON m.album_id = f.album_id""")
def _(c):
    additions = c.photo_tags.select((F.col("tag_id") % 25).alias("album_id"), "photo_id", (F.col("photo_id") * 7 % 1000).alias("order"))
    return up.added_to_albums(c.albums, c.album_photos, additions)[1]


@query("u6_remove_from_people", """WITH b AS (SELECT * FROM {photo_people} WHERE photo_id % 3 <> 0), g AS (SELECT person_id, photo_id FROM {photo_people} WHERE photo_id % 3 = 0)
SELECT p.id, CASE WHEN (p.id, p.cover_photo_id) IN (SELECT (person_id, photo_id) FROM g) THEN (SELECT min(photo_id) FROM b WHERE b.person_id = p.id) ELSE cover_photo_id END AS cover_photo_id FROM {people} p""")
def _(c):
    people, _ = up.removed_from_people(c.people, c.photo_people, c.photo_people.filter("photo_id % 3 = 0"))
    return people.select("id", "cover_photo_id")


@query("s7_replace_exif", "SELECT photo_id, make, model, gps_lat FROM {exif} WHERE photo_id NOT IN (SELECT id FROM {photos} WHERE id % 3 = 0) UNION ALL SELECT id, CASE WHEN id % 2 = 0 THEN 'Sony' END, CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE) FROM {photos} WHERE id % 3 = 0")
def _(c):
    new = c.photos.filter("id % 3 = 0").select(F.col("id").alias("photo_id"), F.when(F.col("id") % 2 == 0, "Sony").alias("make"))
    return up.replaced(c.exif.select("photo_id", "make", "model", "gps_lat"), new, "photo_id")


@query("g5_location_scan", f"""WITH {ANCHORS}, {DAYS}, {NUMS}, fin AS (SELECT nn.id, coalesce(nn.loc, near.loc) AS loc, CASE WHEN nn.loc IS NULL THEN near.lat ELSE nn.lat END AS lat, NOT anchor AS inf FROM nn LEFT JOIN near ON near.id = nn.id WHERE coalesce(nn.loc, near.loc) IS NOT NULL)
SELECT p.id, CASE WHEN fin.lat IS NOT NULL THEN fin.loc ELSE p.location_name END AS location_name, round(coalesce(e.gps_lat, CASE WHEN inf THEN fin.lat + (p.id % 97 - 48) / 80000.0::DOUBLE ELSE fin.lat END), 5) AS gps_lat FROM {{photos}} p LEFT JOIN fin ON fin.id = p.id LEFT JOIN {{exif}} e ON e.photo_id = p.id""")
def _(c):
    from shutterlake.plans.matching import named_gps

    out = loc.sequence_propagated(loc.day_propagated(loc.session_propagated(named_gps(loc.anchors(placed(c))))))
    photos, exif = up.location_scan(c.photos, c.exif, out.select("id", "location_name", "lat", "lon", (~F.col("is_anchor")).alias("is_inferred")))
    return photos.join(exif.select(F.col("photo_id").alias("id"), "gps_lat"), "id", "left").select("id", "location_name", F.round("gps_lat", 5).alias("gps_lat"))


@query("f18_audit_filter", f"""WITH {CANDIDATES}, d AS (SELECT DISTINCT path FROM {{disk}}), r AS (SELECT p.*, d.path, row_number() OVER (PARTITION BY lower(target_folder || '/' || filename), d.path IS NULL ORDER BY created_at DESC, p.id DESC) AS k FROM plan2 p LEFT JOIN d ON d.path = p.file_path)
SELECT id FROM r WHERE NOT (path IS NOT NULL AND k = 1) AND (contains(lower(filename), 'img_') OR contains(lower(target_folder), 'img_') OR contains(lower(category), 'img_'))""")
def _(c):
    return up.audit_filter(organize.validated(organize.planned(candidates(c)), c.disk), "issues", " IMG_ ").select("id")


@query("f18_group_filter", f"WITH RECURSIVE {FP}, {KEYS}, {SCORE}, {GROUPS}, {BEST}, t AS ({TOTALS}) SELECT group_id, n FROM t WHERE confidence >= 90 AND group_id IN (SELECT group_id FROM g WHERE contains(lower(filename), 'copy') OR contains(lower(file_path), 'copy'))")
def _(c):
    fp = prints(c)
    members, totals = dup.groups_and_totals(fp)
    return up.group_filter(totals, "all", 90, "COPY", members).select("group_id", "n")


@query("a16_tab_counts", f'WITH RECURSIVE {FP}, {KEYS}, {SCORE}, {GROUPS}, {BEST}, t AS ({TOTALS}) SELECT count(*) AS "all", count(*) FILTER (is_exact) AS exact, count(*) FILTER (NOT is_exact) AS similar, count(*) FILTER (is_video) AS videos FROM t')
def _(c):
    return up.tab_counts(dup.find_duplicates(prints(c)))


@query("o2_people_orders", "WITH p AS (SELECT p.id, p.name, count(b.photo_id) AS n FROM {people} p LEFT JOIN {photo_people} b ON b.person_id = p.id GROUP BY ALL) SELECT 'count' AS by, id FROM (SELECT id FROM p ORDER BY n DESC, id LIMIT 20) UNION ALL SELECT 'name', id FROM (SELECT id FROM p ORDER BY lower(name), id LIMIT 20)")
def _(c):
    people = op.counted(c.people, c.photo_people, "person_id").select("id", "name", "n")
    top = lambda by: up.sort_people(people, by).limit(20).select(F.lit(by).alias("by"), "id")
    return top("count").unionByName(top("name"))


@query("l8_skip_names", "SELECT id, CASE WHEN row_number() OVER (PARTITION BY base % 50 ORDER BY id) = 1 AND base % 50 >= 25 THEN 'x' || CAST(base % 50 AS VARCHAR) || '.jpg' END AS new_name FROM {photos}")
def _(c):
    plan = c.photos.select("id", F.lit("d").alias("folder"), F.concat(F.lit("x"), (F.col("base") % 50).cast("string"), F.lit(".jpg")).alias("name"))
    existing = plan.filter(F.regexp_extract("name", "([0-9]+)", 1).cast("int") < 25).select("folder", "name").distinct()
    return up.resolved_names(plan, existing, "skip").select("id", "new_name")


@query("l9_move_totals", "SELECT count(*) AS n, CAST(sum(length) AS BIGINT) AS n_bytes FROM {disk}")
def _(c):
    return up.move_totals(organize.move_plan(c.disk.select("path", F.col("length").alias("file_size")), "/lib", "/moved"))


@query("u7_merge_chains", "WITH m AS (SELECT id, id - id % 4 AS e FROM {people}) SELECT m.e AS person_id, count(*) AS n FROM {faces} f JOIN m ON m.id = f.person_id GROUP BY 1 UNION ALL SELECT person_id, count(*) FROM {faces} WHERE person_id NOT IN (SELECT id FROM {people}) GROUP BY 1")
def _(c):
    merges = c.people.filter("id % 4 > 0").select(F.col("id").alias("old"), (F.col("id") - 1).alias("new"))  # each into the one before it
    return op.moved_faces(c.faces, merges).groupBy("person_id").agg(F.count("*").alias("n"))
