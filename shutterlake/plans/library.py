"""Organization, people, classification, source and streaming queries with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shutterlake.operators import classify, organize, people, pictures
from shutterlake.plans.views import Catalog, duckdb_sql
from shutterlake.sources import media
from shutterlake.streaming import catalogue as stream
from shutterlake.streaming import places

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql:
            ORACLES[name] = duckdb_sql(sql)
        return f

    return put


def candidates(c: Catalog):
    """Live photos with coordinates, sorted names of their people and whether they are a later copy."""
    names = c.photo_people.join(c.people.select(F.col("id").alias("person_id"), "name"), "person_id").groupBy(F.col("photo_id").alias("id")).agg(F.array_sort(F.collect_list("name")).alias("names"))
    first = c.photos.filter("perceptual_hash <> ''").groupBy("perceptual_hash").agg(F.min("id").alias("first_id"))
    photos = c.photos.filter("not is_trashed").join(first, "perceptual_hash", "left").withColumn("is_duplicate", F.coalesce(F.col("id") > F.col("first_id"), F.lit(False)))
    return photos.join(names, "id", "left").join(c.exif.select(F.col("photo_id").alias("id"), "gps_lat", "gps_lon"), "id", "left")


CANDIDATES = """cand AS (SELECT p.*, e.gps_lat, e.gps_lon, n.names, p.perceptual_hash <> '' AND p.id > min(CASE WHEN perceptual_hash <> '' THEN p.id END) OVER (PARTITION BY perceptual_hash) AS dup0, lower(filename) AS f, lower(file_path) AS fp2, CAST(year(created_at) AS VARCHAR) AS y, monthname(created_at) AS mo
  FROM {photos} p LEFT JOIN {exif} e ON e.photo_id = p.id LEFT JOIN (SELECT photo_id, list(name ORDER BY name) FILTER (name <> 'Unknown Person') AS names FROM {photo_people} b JOIN {people} x ON x.id = b.person_id GROUP BY 1) n ON n.photo_id = p.id),
live AS (SELECT * FROM cand WHERE NOT is_trashed), kind AS (SELECT *, dup0 AS dup, is_document OR regexp_matches(f, 'aadhaar|aadhar|adhar|pan_card|pancard|passport|receipt|invoice|bill_|[.]pdf$|[.]txt$') AS doc, regexp_matches(f, 'screenshot|screen shot|screencap|^ss_|^scr_') AS shot, regexp_matches(f, '^(img|vid|stk)-[0-9][0-9][0-9][0-9][0-9][0-9][0-9][0-9]-wa[0-9][0-9][0-9][0-9]+[.]') AS wa, mime_type LIKE 'video%' AS vid FROM live),
plan AS (SELECT *, CASE WHEN dup THEN 'Duplicates' WHEN doc THEN 'Documents' WHEN shot THEN 'Screenshots' WHEN wa THEN 'WhatsApp' WHEN len(names) > 0 THEN 'People' WHEN gps_lat IS NOT NULL AND trim(location_name) <> '' THEN 'Places' WHEN is_favorite THEN 'Favorites' WHEN vid THEN 'Videos' ELSE 'Photos' END AS category FROM kind),
plan2 AS (SELECT *, CASE category WHEN 'Duplicates' THEN y || '/Duplicates (Review)' WHEN 'Documents' THEN y || '/Documents/' || coalesce(document_category, 'General Documents') WHEN 'Screenshots' THEN y || '/Screenshots' WHEN 'WhatsApp' THEN y || '/WhatsApp/' || CASE WHEN vid THEN 'Videos' ELSE 'Photos' END
  WHEN 'People' THEN y || '/People/' || array_to_string(names[1:2], ' & ') WHEN 'Places' THEN y || '/Trip - ' || trim(location_name) WHEN 'Favorites' THEN y || '/Favorites' WHEN 'Videos' THEN y || '/Videos' ELSE y || '/' || mo END AS target_folder FROM plan)"""


@query("l1_plan_paths", f"WITH {CANDIDATES} SELECT id, category, target_folder FROM plan2")
def _(c):
    return organize.planned(candidates(c)).select("id", "category", "target_folder")


@query("l2_candidates_below_a_folder", "SELECT id, gps_lat, gps_lon FROM {photos} p LEFT JOIN {exif} e ON e.photo_id = p.id WHERE NOT is_trashed AND starts_with(file_path, '/lib/c1')")
def _(c):
    return organize.plan_candidates(c.photos, c.exif, prefix="/lib/c1").select("id", "gps_lat", "gps_lon")


@query("l2_candidates_by_id", "SELECT id, filename, gps_lat FROM {photos} p LEFT JOIN {exif} e ON e.photo_id = p.id WHERE NOT is_trashed AND id IN (SELECT photo_id FROM {album_photos} WHERE album_id = 3)")
def _(c):
    return organize.plan_candidates(c.photos, c.exif, ids=c.album_photos.filter("album_id = 3").select(F.col("photo_id").alias("id"))).select("id", "filename", "gps_lat")


@query("l4_preview", f"""WITH {CANDIDATES}, k AS (SELECT *, row_number() OVER (PARTITION BY target_folder ORDER BY created_at DESC, id DESC) AS k FROM plan2)
SELECT split_part(target_folder, '/', 1) AS top_folder, target_folder, count(*) AS n, CAST(sum(file_size) AS BIGINT) AS n_bytes, string_agg(filename, ', ' ORDER BY k) FILTER (k <= 3) AS samples FROM k GROUP BY target_folder""")
def _(c):
    return organize.preview(organize.planned(candidates(c)))


@query("l5_validate", f"""WITH {CANDIDATES}, d AS (SELECT DISTINCT path FROM {{disk}}), r AS (SELECT p.*, d.path, row_number() OVER (PARTITION BY lower(target_folder || '/' || filename), d.path IS NULL ORDER BY created_at DESC, p.id DESC) AS k FROM plan2 p LEFT JOIN d ON d.path = p.file_path)
SELECT CASE WHEN path IS NULL THEN 'missing_source' WHEN k = 1 THEN 'matched' ELSE 'collision_renamed' END AS status, count(*) AS n, CAST(sum(file_size) AS BIGINT) AS n_bytes FROM r GROUP BY 1""")
def _(c):
    return organize.validated(organize.planned(candidates(c)), c.disk).groupBy("status").agg(F.count("*").alias("n"), F.sum("file_size").alias("n_bytes"))


@query("l6_audit_destination", "SELECT coalesce(p.file_path, d.path) AS path, CASE WHEN d.path IS NULL THEN 'missing' WHEN p.id IS NULL THEN 'unexpected' WHEN p.size <> d.length THEN 'resized' ELSE 'ok' END AS status FROM (SELECT id, file_path, file_size + CASE WHEN id % 40 = 0 THEN 1 ELSE 0 END AS size FROM {photos}) p FULL JOIN {disk} d ON d.path = p.file_path")
def _(c):
    manifest = c.photos.select(F.col("file_path").alias("path"), (F.col("file_size") + F.when(F.col("id") % 40 == 0, 1).otherwise(0)).alias("size"))
    return organize.audited(manifest, c.disk)


@query("l7_source_breakdown", "SELECT CASE WHEN ext <> '.zip' THEN 'media' ELSE 'other' END AS side, ext, count(*) AS n, CAST(sum(length) AS BIGINT) AS n_bytes FROM (SELECT lower(regexp_extract(path, '([.][^./]*)$', 1)) AS ext, length FROM {disk}) GROUP BY ALL")
def _(c):
    return organize.source_breakdown(c.disk)


@query("l8_free_names", "SELECT id, CASE WHEN k = 0 THEN name ELSE replace(name, '.jpg', ' (' || k || ').jpg') END AS new_name FROM (SELECT id, 'x' || CAST(base % 50 AS VARCHAR) || '.jpg' AS name, row_number() OVER (PARTITION BY base % 50 ORDER BY id) + CASE WHEN base % 50 < 25 THEN 0 ELSE -1 END AS k FROM {photos})")
def _(c):
    plan = c.photos.select("id", F.lit("d").alias("folder"), F.concat(F.lit("x"), (F.col("base") % 50).cast("string"), F.lit(".jpg")).alias("name"))
    existing = plan.filter(F.regexp_extract("name", "([0-9]+)", 1).cast("int") < 25).select("folder", "name").distinct()
    return organize.free_names(plan, existing).select("id", "new_name")


@query("l9_move_plan", "SELECT path, '/moved/' || substr(path, 6) AS new_path FROM {disk}")
def _(c):
    return organize.move_plan(c.disk.select("path"), "/lib", "/moved")


@query("p1_assign_faces", """WITH f AS (SELECT * FROM {faces} WHERE id % 5 = 0), g AS (SELECT * FROM {faces} WHERE id % 5 <> 0),
d AS (SELECT f.id, g.person_id, g.id AS gid, sqrt(list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE) for x in list_zip(f.descriptor, g.descriptor)])) AS d FROM f, g)
SELECT id, person_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, gid) AS k FROM d WHERE d < 1.15) WHERE k = 1""")
def _(c):
    own = c.faces.select("id", "person_id", "descriptor")
    return people.assigned_faces(own.filter("id % 5 = 0").drop("person_id"), own.filter("id % 5 <> 0"), 1.15).select("id", "person_id", F.round("distance", 6).alias("distance"))


@query("p2_cluster_faces", """WITH RECURSIVE e AS (SELECT a.id AS src, b.id AS dst FROM {faces} a JOIN {faces} b ON a.id <> b.id WHERE sqrt(list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE) for x in list_zip(a.descriptor, b.descriptor)])) < 1.1),
w AS (SELECT id, id AS t FROM {faces} UNION SELECT w.id, e.dst FROM w JOIN e ON e.src = w.t) SELECT id, min(t) AS cluster_id FROM w GROUP BY id""")
def _(c):
    return people.clustered_faces(c.faces.select("id", "descriptor"), 1.1)


SUGGESTIONS = """WITH d AS (SELECT least(a.person_id, b.person_id) AS a, greatest(a.person_id, b.person_id) AS b, sqrt(list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE) for x in list_zip(a.descriptor, b.descriptor)])) AS d FROM {faces} a JOIN {faces} b ON a.id < b.id AND a.person_id <> b.person_id),
s AS (SELECT a, b, min(d) AS m, avg(d) AS mean FROM d GROUP BY ALL), n AS (SELECT person_id, count(*) AS n FROM {faces} GROUP BY 1), e AS (SELECT a, b, least(m, 1.0) AS m, CASE WHEN x.n > 2 AND y.n > 2 THEN 0.65 * least(m, 1.0) + 0.35 * mean ELSE least(m, 1.0) END AS eff FROM s JOIN n x ON x.person_id = a JOIN n y ON y.person_id = b)
SELECT a, b, round(m, 4) AS distance, round(eff, 4) AS effective, CAST(CASE WHEN eff <= 0.9 THEN 99 WHEN eff <= 1.2 THEN round(99 - (eff - 0.9) / (1.2 - 0.9) * 24) ELSE greatest(50, round(75 - (eff - 1.2) / 0.12 * 25)) END AS INTEGER) AS confidence FROM e WHERE m <= 1.0 OR eff <= 1.2"""


@query("p3_merge_suggestions", SUGGESTIONS)
def _(c):
    return people.merge_suggestions(c.faces.select("id", "person_id", "descriptor"), sure=1.0, likely=1.2, best=0.9)


@query("d14_structural_pairs", """WITH g AS (SELECT id, person_id, [floor(128 + 127 * x::DOUBLE) for x in descriptor] AS t FROM {faces}), p AS (SELECT id AS a, lead(id) OVER w AS b, t AS x, lead(t) OVER w AS y FROM g WINDOW w AS (PARTITION BY person_id ORDER BY id)),
m AS (SELECT a, b, list_avg(x) AS mx, list_avg(y) AS my, list_aggregate(x, 'var_pop') AS vx, list_aggregate(y, 'var_pop') AS vy, list_avg([z[1] * z[2] for z in list_zip(x, y)]) AS xy FROM p WHERE b IS NOT NULL)
SELECT a, b, round(least(1, greatest(0, (2 * mx * my + 6.5025) * (2 * (xy - mx * my) + 58.5225) / ((mx * mx + my * my + 6.5025) * (vx + vy + 58.5225)))), 6) AS ssim FROM m""")
def _(c):
    grids = c.faces.select("id", F.transform("descriptor", lambda x: F.floor(128 + 127 * x.cast("double")).cast("double")).alias("grid"))
    follows = F.lead("id").over(Window.partitionBy("person_id").orderBy("id"))
    return pictures.structural_pairs(c.faces.select(F.col("id").alias("a"), follows.alias("b")), grids).select("a", "b", F.round("ssim", 6).alias("ssim"))


@query("p4_auto_merge", f"""WITH RECURSIVE sug AS ({SUGGESTIONS}), op AS (SELECT * FROM sug WHERE NOT (a = 0 AND b = 1)), ch AS (SELECT * FROM op WHERE confidence >= 70 OR NOT EXISTS (SELECT 1 FROM op WHERE confidence >= 70)),
lk AS (SELECT a AS src, b AS dst FROM ch UNION SELECT b, a FROM ch), wk AS (SELECT src AS id, src AS t FROM lk UNION SELECT wk.id, lk.dst FROM wk JOIN lk ON lk.src = wk.t) SELECT id AS old, min(t) AS new FROM wk GROUP BY id HAVING id <> min(t)""")
def _(c):
    found = people.merge_suggestions(c.faces.select("id", "person_id", "descriptor"), sure=1.0, likely=1.2, best=0.9)
    return people.auto_merges(found, found.filter("a = 0 and b = 1").select("a", "b"), 70)


SHOT = """CASE WHEN regexp_matches(f, '^screenshot_[0-9]{8}[-_][0-9]{6}') THEN 'mobile' WHEN regexp_matches(f, 'screenshot|screen[ _-]shot|screencap|screengrab|snip|printscreen|prtscn') THEN CASE WHEN regexp_matches(f, 'android|ios|phone') THEN 'mobile' ELSE 'desktop' END
  WHEN regexp_matches(f, '[.](png|webp)$') AND (width, height) IN ((1080, 1920), (1170, 2532), (1920, 1080)) THEN 'mobile' END"""


@query("m4_a10_screenshots", f"SELECT category, count(*) AS n, CAST(sum(file_size) AS BIGINT) AS n_bytes FROM (SELECT file_size, {SHOT} AS category FROM (SELECT *, lower(filename) AS f FROM {{photos}})) WHERE category IS NOT NULL GROUP BY 1")
def _(c):
    return c.photos.withColumn("category", classify.screenshot_category()).filter("category is not null").groupBy("category").agg(F.count("*").alias("n"), F.sum("file_size").alias("n_bytes"))


@query("m5_organizer_kinds", "SELECT id, regexp_matches(f, 'screenshot') AS screenshot, mime_type LIKE 'video%' AS video, is_document AS document, regexp_matches(f, '-wa[0-9][0-9][0-9][0-9]') AS whatsapp, FALSE AS social FROM (SELECT *, lower(filename) AS f FROM {photos})")
def _(c):
    return c.photos.select("id", *[v.alias(k) for k, v in organize.kinds().items()])


TEXT = "text || CASE doc_id % 11 WHEN 0 THEN ' POV: you are late, lmao' WHEN 1 THEN ' link in bio @someone' WHEN 2 THEN ' TAX INVOICE lmao total: 45 $90' WHEN 3 THEN ' 3 days ago via @user_1' WHEN 4 THEN ' visit https://a.b/c and subscribe' WHEN 5 THEN ' receipt date: 01/02/2020 mail a.b@c.org phone: 9876543210 Total: ₹ 400' ELSE '' END"
LOW = "low AS (SELECT doc_id, " + TEXT + " AS t, lower(" + TEXT + ") AS low FROM documents)"


@query("c2_social_text", f"WITH {LOW} SELECT doc_id, signals FROM (SELECT doc_id, CASE WHEN regexp_matches(low, '{'|'.join(classify.DOCUMENT_MARKS)}') THEN '' ELSE concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(low, '{p}') THEN '{k}' END" for k, p in classify.SOCIAL.items()).replace("{3,}", "[a-z0-9_][a-z0-9_]+") + f", CASE WHEN regexp_matches(low, '{classify.CHAT}') AND NOT regexp_matches(low, 'invoice|total') THEN 'chat' END) END AS signals FROM low) WHERE signals <> ''")
def _(c):
    out = c.documents.select("doc_id", F.array_join(classify.social_signals(F.expr(TEXT)), ",").alias("signals"))
    return out.filter("signals <> ''")


def terms(*words: str) -> str:
    return "(" + " + ".join(f"contains(low, '{w}')::INT" for w in words) + ")"


def any_of(patterns) -> str:
    return "|".join(patterns).replace("\\d", "[0-9]")


LOOKS = rf"""{LOW}, m AS (SELECT *, {terms(*classify.IDENTITY_TERMS)} AS meta, len(regexp_extract_all(t, '\S+')) AS words,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[0-9]') AND regexp_matches(x, '[a-zA-Z]'))) AS n_lines FROM low),
i AS (SELECT *, regexp_matches(low, '{any_of(classify.AADHAAR_WORDS)}') OR meta >= 2 OR (regexp_matches(t, '{any_of([classify.AADHAAR_NUMBER])}') AND (meta >= 1 OR regexp_matches(low, 'india|govt')))
  OR regexp_matches(t, '{any_of([classify.PAN_NUMBER])}') OR regexp_matches(low, '{any_of(classify.IDENTITY_PHRASES)}') AS identity FROM m),
scored AS (SELECT *, CAST(CASE WHEN identity THEN 100
  ELSE least(20, CASE WHEN words > 50 THEN 10 WHEN words >= 10 THEN 5 ELSE 0 END + CASE WHEN words >= 5 THEN 5 ELSE 0 END) + least(20, least(10, 5 * len(regexp_extract_all(t, '[A-Za-z]+:'))) + CASE WHEN n_lines > 3 THEN 10 ELSE 0 END)
    + least(20, 5 * {terms(*classify.DOCUMENT_KEYWORDS)}) + least(40, 10 * ({" + ".join(f"regexp_matches(t, '{any_of([x])}')::INT" for x in classify.DOCUMENT_PATTERNS)}))
    - 30 * {terms(*classify.JUNK_WORDS)} END AS INTEGER) AS score FROM i)"""


@query("c6_text_density", f"WITH {LOOKS} SELECT doc_id, coalesce(score, 0) AS score FROM scored")
def _(c):
    return c.documents.select("doc_id", F.coalesce(classify.text_density_score(F.expr(TEXT)), F.lit(0)).alias("score"))


#: Rules derived from the benchmark: an item's words are a rule's keywords, its first letters a pattern.
RULES = "SELECT item_id AS id, 'class ' || CAST(item_id % 7 AS VARCHAR(9)) AS category, {words} AS keywords, CASE WHEN item_id % 2 = 0 THEN 'tot.l:? [0-9]+' ELSE '' END AS regex FROM benchmark"


@query("c6_text_categories", f"""WITH {LOOKS}, rules AS ({RULES.format(words="list_distinct(string_split(lower(text), ' '))")}),
p AS (SELECT doc_id, id, category, 2 * len(list_filter(list_filter(list_transform(keywords, lambda k: trim(k)), lambda k: len(k) >= 3 AND NOT list_contains({list(classify.STOP_WORDS)}, k)), lambda k: contains(low, k))) + CASE WHEN regex <> '' AND regexp_matches(t, '(?i)' || regex) THEN 5 ELSE 0 END AS points
  FROM scored, rules WHERE score >= {classify.DOCUMENT_SCORE} AND NOT identity),
b AS (SELECT doc_id, category FROM p WHERE points > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, id) = 1)
SELECT doc_id, coalesce(score, 0) AS score, CASE WHEN identity THEN '{classify.IDENTITY_CATEGORY}' WHEN score >= {classify.DOCUMENT_SCORE} THEN coalesce(b.category, '{classify.OTHER_CATEGORY}') END AS category FROM scored LEFT JOIN b USING (doc_id)""")
def _(c):
    rules = c.benchmark.select(
        F.col("item_id").alias("id"), F.concat(F.lit("class "), (F.col("item_id") % 7).cast("string")).alias("category"), F.array_distinct(F.split(F.lower("text"), " ")).alias("keywords"),
        F.when(F.col("item_id") % 2 == 0, "tot.l:? [0-9]+").otherwise("").alias("regex"))
    docs = c.documents.select("doc_id", F.expr(TEXT).alias("text"))
    return classify.text_categories(docs, rules).drop("text")


@query("s2_media_types", "SELECT file_path AS path, regexp_extract(lower(file_path), '[.]([^./]*)$', 1) AS ext, CASE regexp_extract(lower(file_path), '[.]([^./]*)$', 1) WHEN 'nef' THEN 'raw' WHEN 'mp4' THEN 'video' WHEN 'pdf' THEN 'document' ELSE 'photo' END AS kind, CASE WHEN lower(file_path) LIKE '%.jpg' OR lower(file_path) LIKE '%.jpeg' THEN 'image/jpeg' ELSE mime_type END AS mime FROM {photos}")
def _(c):
    return c.photos.select(F.col("file_path").alias("path"), media.media_type(F.col("file_path")).alias("m")).select("path", "m.ext", "m.kind", "m.mime")


@query("s3_catalog_rows", "SELECT file_path AS path, filename, coalesce(CASE WHEN id % 3 = 0 THEN created_at END, CASE WHEN id % 3 = 1 THEN created_at + INTERVAL 1 DAY END, created_at + INTERVAL 2 DAY) AS created_at, CASE WHEN id % 7 = 0 THEN NULL ELSE '1/' || CAST(id % 7 * 100 AS VARCHAR) END AS exposure_time FROM {photos}")
def _(c):
    at, i = F.col("created_at"), F.col("id")
    files = c.photos.select(F.col("file_path").alias("path"), F.when(i % 3 == 0, at).alias("taken_at"), F.when(i % 3 == 1, at + F.expr("interval 1 day")).alias("digitized_at"), (at + F.expr("interval 2 days")).alias("modified_at"), F.when(i % 7 > 0, 1.0 / (i % 7 * 100)).alias("exposure_s"))
    return media.catalog_rows(files).drop("mime_type")


@query("s5_source_folders", "SELECT path, coalesce((SELECT min(folder_path) FROM {folders} f WHERE starts_with(path, folder_path || '/')), regexp_replace(path, '/[^/]*$', '')) AS source_folder_path FROM {disk}")
def _(c):
    return media.assigned_folders(c.disk.select("path"), c.folders)


def events(c: Catalog):
    return c.events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("t3_stream_exact_dedup", "SELECT DISTINCT event_id FROM events")
def _(c):
    return stream.drained(events(c), lambda e: stream.stream_exact_dedup(e, "event_id").select("event_id"), close=False)


SESSIONS = "e AS (SELECT *, ts::TIMESTAMP AS t FROM events), g AS (SELECT *, CASE WHEN epoch(t) - epoch(lag(t) OVER o) <= 12600 THEN 0 ELSE 1 END AS new FROM e WINDOW o AS (PARTITION BY user_id ORDER BY t, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM g)"


@query("t4_stream_sessions", f"WITH {SESSIONS} SELECT user_id, min(t) AS first, max(t) + INTERVAL 210 MINUTE AS last, count(*) AS n FROM s GROUP BY user_id, session")
def _(c):
    return stream.drained(events(c), lambda e: stream.stream_sessions(e, "user_id"))


@query("t5_stream_bursts", "SELECT make_timestamp(CAST(floor(epoch(ts::TIMESTAMP) / 4) AS BIGINT) * 4000000) AS slot, count(*) AS n FROM events GROUP BY 1")
def _(c):
    return stream.drained(events(c), stream.stream_bursts)


@query("t6_stream_timeline", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def _(c):
    return stream.drained(events(c), stream.stream_timeline)


@query("t7_stream_propagate", f"""WITH {SESSIONS}, p AS (SELECT *, CASE WHEN event_type = 'click' THEN 'place ' || event_id % 3 END AS place FROM s), c AS (SELECT user_id, session, place, count(*) AS n, min(floor(epoch(t))) AS f FROM p WHERE place IS NOT NULL GROUP BY ALL),
b AS (SELECT user_id, session, place AS best FROM c QUALIFY row_number() OVER (PARTITION BY user_id, session ORDER BY n DESC, f, place) = 1) SELECT p.user_id, event_id AS id, coalesce(place, best) AS place FROM p LEFT JOIN b ON b.user_id = p.user_id AND b.session = p.session""")
def _(c):
    place = F.when(F.col("event_type") == "click", F.concat(F.lit("place "), (F.col("event_id") % 3).cast("string")))
    own = events(c).select("user_id", "ts", F.col("event_id").alias("id"), place.alias("place"))
    with places.list_state(own.sparkSession):
        return stream.drained(own, lambda e: places.stream_propagated(e, "user_id"))
