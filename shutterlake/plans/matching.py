"""Duplicate and location queries with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.functions import places
from shutterlake.operators import duplicates as dup
from shutterlake.operators import locations as loc
from shutterlake.operators.components import connected_components
from shutterlake.plans.core import hamming_sql
from shutterlake.plans.views import Catalog, duckdb_sql
from shutterlake.session import written

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql:
            ORACLES[name] = duckdb_sql(sql)
        return f

    return put


def prints(c: Catalog):
    """Fingerprints of live photos with what pairs are scored by."""
    own = c.photos.filter("not is_trashed").select("id", "file_path", "filename", "file_size", "created_at", "width", "height", "mime_type")
    return own.join(c.fingerprints.drop("base").withColumnRenamed("photo_id", "id"), "id")


FP = """fp AS MATERIALIZED (SELECT p.id, p.file_path, p.filename, p.file_size, p.created_at, p.width, p.height, p.mime_type, f.sha256, f.partial_sha256, f.dhash, f.phash, f.video_duration,
  trim(regexp_replace(regexp_replace(lower(p.filename), '\\.[^.]*$', ''), '(\\s*-\\s*copy|\\s*\\(\\d+\\))+', '', 'g')) AS cn, lower(regexp_extract(p.filename, '(\\.[^.]*)$', 1)) AS ext FROM {photos} p JOIN {fingerprints} f ON f.photo_id = p.id WHERE NOT p.is_trashed)"""
KEYS = """k AS (SELECT id, 'size' AS fam, 'size_' || file_size AS key FROM fp WHERE file_size > 0 UNION ALL SELECT id, 'digest', 's_' || sha256 FROM fp WHERE sha256 <> '' UNION ALL SELECT id, 'digest', 'p_' || partial_sha256 FROM fp WHERE partial_sha256 <> ''
  UNION ALL SELECT id, 'digest', 'base_' || cn || '_' || ext FROM fp WHERE length(cn) > 1 UNION ALL SELECT id, 'burst', 't_' || CAST(floor(epoch(created_at) / 4) AS BIGINT) FROM fp WHERE epoch(created_at) > 0
  UNION ALL SELECT id, 'sequence', 'n_' || regexp_extract(filename, '([0-9][0-9][0-9][0-9]+)', 1) FROM fp WHERE regexp_matches(filename, '[0-9][0-9][0-9][0-9]') UNION ALL SELECT id, 'band', 'd' || b || '_' || substr(dhash, b * 16 + 1, 16) FROM fp, range(4) t(b) WHERE length(dhash) = 64
  UNION ALL SELECT id, 'band', 'p' || b || '_' || substr(phash, b * 4 + 1, 4) FROM fp, range(4) t(b) WHERE length(phash) = 16 UNION ALL SELECT id, 'duration', 'v_' || CAST(floor(video_duration + 0.5) + o AS BIGINT) FROM fp, range(-1, 2) t(o) WHERE video_duration > 0),
s AS (SELECT key FROM k GROUP BY fam, key HAVING count(*) BETWEEN 2 AND CASE fam WHEN 'size' THEN 1000 WHEN 'digest' THEN 1000 WHEN 'band' THEN 30 WHEN 'duration' THEN 30 ELSE 25 END),
c AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y ON x.key = y.key AND x.id < y.id WHERE x.key IN (SELECT key FROM s))"""
SCORE = f"""d AS (SELECT c.a, c.b, x.mime_type LIKE 'video%' AS video, x.sha256 = y.sha256 AS sha, x.partial_sha256 = y.partial_sha256 AND x.file_size = y.file_size AS part, x.cn = y.cn AND x.ext = y.ext AND length(x.cn) > 1 AS named, abs(x.file_size - y.file_size) < 1024 AS near,
  abs(x.width / y.height * y.height / x.height - y.width / y.height) > 0.20 AS apart, abs(coalesce(x.video_duration, 0) - coalesce(y.video_duration, 0)) AS sec, {hamming_sql('x.dhash', 'y.dhash')} AS d, {hamming_sql('x.phash', 'y.phash')} AS p
  FROM c JOIN fp x ON x.id = c.a JOIN fp y ON y.id = c.b WHERE abs((x.mime_type LIKE 'video%')::INT - (y.mime_type LIKE 'video%')::INT) = 0),
e AS (SELECT a, b, video, CASE WHEN sha THEN 100 WHEN video THEN CASE WHEN named THEN 99 WHEN sec > 3 THEN NULL WHEN d <= 14 OR (d <= 22 AND p <= 6) THEN CASE WHEN d <= 6 AND sec <= 0.5 THEN 98 WHEN d <= 10 THEN 95 ELSE 90 END END
  WHEN part THEN 99 WHEN named THEN CASE WHEN near THEN 100 ELSE 99 END WHEN apart THEN NULL WHEN d <= 8 OR (d <= 12 AND p <= 4) THEN 95 WHEN d <= 16 OR (d <= 20 AND p <= 6) THEN 90 WHEN d <= 24 AND p <= 10 THEN 85 END AS confidence FROM d)"""
SCORE = SCORE.replace("abs(x.width / y.height * y.height / x.height - y.width / y.height)", "abs(x.width / x.height - y.width / y.height)")
GROUPS = """r AS (SELECT a AS src, b AS dst FROM e WHERE confidence IS NOT NULL UNION SELECT b, a FROM e WHERE confidence IS NOT NULL), w AS (SELECT src AS id, src AS t FROM r UNION SELECT w.id, r.dst FROM w JOIN r ON r.src = w.t), m AS (SELECT id, min(t) AS group_id FROM w GROUP BY id)"""
BEST = "g AS (SELECT fp.*, m.group_id, row_number() OVER (PARTITION BY m.group_id ORDER BY width * height DESC, file_size DESC, fp.id) AS rank FROM fp JOIN m ON m.id = fp.id)"
TOTALS = """SELECT g.group_id, max(CASE WHEN rank = 1 THEN g.id END) AS master_id, count(*) AS n, CAST(sum(file_size) AS BIGINT) AS total_bytes, CAST(coalesce(sum(CASE WHEN rank > 1 THEN file_size END), 0) AS BIGINT) AS recoverable_bytes, bool_or(mime_type LIKE 'video%') AS is_video,
  any_value(q.confidence) AS confidence, any_value(q.is_exact) AS is_exact FROM g JOIN (SELECT m.group_id, greatest(max(confidence), 75) AS confidence, bool_and(confidence >= 99) AS is_exact FROM e JOIN m ON m.id = e.a WHERE confidence IS NOT NULL GROUP BY 1) q ON q.group_id = g.group_id GROUP BY g.group_id"""


@query("d5_candidate_pairs", f"WITH {FP}, {KEYS} SELECT a, b FROM c")
def _(c):
    return dup.candidate_pairs(prints(c))


@query("d6_d7_scored_pairs", f"WITH {FP}, {KEYS}, {SCORE} SELECT a, b, confidence, confidence >= 99 AS is_exact, video AS is_video FROM e WHERE confidence IS NOT NULL")
def _(c):
    return dup.scored_candidates(prints(c)).drop("label")


def turned(n: int) -> str:
    """The difference hash with its first ``n`` digits complemented: ``4 * n`` bits away."""
    return f"translate(substr(dhash, 1, {n}), '0123456789abcdef', 'fedcba9876543210') || substr(dhash, {n + 1})"


#: Prints in which copies are 20 or 28 bits from their originals, films and pictures, with histograms, hashes of the turned picture and key frames, so that every rung of the ladders is trodden.
RUNGS = {
    "mime_type": "CASE WHEN base % 3 = 1 THEN 'video/mp4' ELSE 'image/jpeg' END",
    "video_duration": "CASE WHEN base % 3 = 1 THEN CAST(base % 300 + CASE id % 40 WHEN 32 THEN 2 ELSE 0 END AS DOUBLE) + CAST(0.5 AS DOUBLE) END",
    "seen": "dhash",
    "dhash": f"CASE id % 40 WHEN 12 THEN {turned(5)} WHEN 22 THEN {turned(7)} WHEN 32 THEN {turned(7)} ELSE dhash END",
    "color_histogram": "CASE WHEN id % 10 = 2 AND id % 9 IN (1, 4) THEN list_value(CAST(0.2 AS DOUBLE), CAST(0.3 AS DOUBLE), CAST(0.2 AS DOUBLE), CAST(0.3 AS DOUBLE)) WHEN id % 10 = 2 AND id % 9 = 2 THEN list_value(CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0.2 AS DOUBLE), CAST(0.8 AS DOUBLE)) ELSE list_value(CAST(0.4 AS DOUBLE), CAST(0.3 AS DOUBLE), CAST(0.2 AS DOUBLE), CAST(0.1 AS DOUBLE)) END",
}
RUNG_PRINTS = f"""fp AS MATERIALIZED (SELECT id, file_path, filename, file_size, created_at, width, height, sha256, partial_sha256, phash, cn, ext, {", ".join(f"{e} AS {n}" for n, e in RUNGS.items())}
  FROM (SELECT p.* EXCLUDE (mime_type), f.sha256, f.partial_sha256, f.dhash, f.phash, trim(regexp_replace(regexp_replace(lower(p.filename), '\\.[^.]*$', ''), '(\\s*-\\s*copy|\\s*\\(\\d+\\))+', '', 'g')) AS cn, lower(regexp_extract(p.filename, '(\\.[^.]*)$', 1)) AS ext
    FROM {{photos}} p JOIN {{fingerprints}} f ON f.photo_id = p.id WHERE NOT p.is_trashed) q)"""
RUNG_SCORE = f"""d0 AS (SELECT c.a, c.b, x.mime_type LIKE 'video%' AS video, x.sha256 = y.sha256 AS sha, x.partial_sha256 = y.partial_sha256 AND x.file_size = y.file_size AS part, x.cn = y.cn AND x.ext = y.ext AND length(x.cn) > 1 AS named, abs(x.file_size - y.file_size) < 1024 AS near,
  abs(x.width / x.height - y.width / y.height) > 0.20 AS apart, abs(coalesce(x.video_duration, 0) - coalesce(y.video_duration, 0)) AS sec, {hamming_sql('x.dhash', 'y.dhash')} AS d, {hamming_sql('x.phash', 'y.phash')} AS p,
  CASE WHEN x.mime_type LIKE 'video%' THEN NULL ELSE {hamming_sql('x.dhash', 'y.seen')} END AS rot, CASE WHEN x.mime_type LIKE 'video%' THEN {hamming_sql('x.seen', 'y.seen')} ELSE 999 END AS frames, list_sum([least(x.color_histogram[i], y.color_histogram[i]) for i in range(1, 5)]) AS likeness
  FROM c JOIN fp x ON x.id = c.a JOIN fp y ON y.id = c.b WHERE abs((x.mime_type LIKE 'video%')::INT - (y.mime_type LIKE 'video%')::INT) = 0),
d AS (SELECT * REPLACE (CASE WHEN d > 14 AND d <= 26 AND p <= 8 THEN least(d, coalesce(rot, d)) ELSE d END AS d) FROM d0),
e AS (SELECT a, b, video, CASE WHEN sha THEN 100 WHEN video THEN CASE WHEN named THEN 99 WHEN sec > 3 THEN NULL WHEN d <= 14 OR (d <= 22 AND p <= 6) THEN CASE WHEN d <= 6 AND sec <= 0.5 THEN 98 WHEN d <= 10 THEN 95 ELSE 90 END WHEN frames <= 12 AND sec <= 1 THEN 95 WHEN frames <= 22 THEN 90 END
  WHEN part THEN 99 WHEN named THEN CASE WHEN near THEN 100 ELSE 99 END WHEN apart THEN NULL WHEN d <= 8 OR (d <= 12 AND p <= 4) THEN 95 WHEN d <= 16 OR (d <= 20 AND p <= 6) THEN 90 WHEN d <= 24 AND p <= 10 THEN 85 WHEN d <= 36 AND likeness >= 0.85 THEN 80 WHEN d <= 36 AND likeness >= 0.70 THEN 75 END AS confidence FROM d)"""


def rung_prints(c: Catalog):
    own = c.photos.filter("not is_trashed").select("id", "base", "file_path", "filename", "file_size", "created_at", "width", "height")
    own = own.join(c.fingerprints.drop("base", "video_duration").withColumnRenamed("photo_id", "id"), "id")
    own = own.withColumns({n: F.expr(RUNGS[n].replace("list_value(", "array(")) for n in ("mime_type", "video_duration", "color_histogram")}).withColumn("seen", F.col("dhash")).withColumn("dhash", F.expr(RUNGS["dhash"]))
    film = F.col("mime_type") == "video/mp4"
    return own.withColumns({"rotations": F.when(~film, F.array("seen", F.repeat(F.lit("0"), 64))), "video_keyframes": F.when(film, F.array("seen", F.repeat(F.lit("0"), 64)))}).drop("seen", "base")


@query("d6_d8_every_rung", f"WITH {RUNG_PRINTS}, {KEYS}, {RUNG_SCORE} SELECT a, b, confidence, video AS is_video FROM e WHERE confidence IS NOT NULL")
def _(c):
    return dup.scored_candidates(rung_prints(c), rotations=True).select("a", "b", "confidence", "is_video")


@query("c1_connected_components", "WITH RECURSIVE r AS (SELECT base AS src, id AS dst FROM {photos} WHERE id <> base UNION SELECT id, base FROM {photos} WHERE id <> base), w AS (SELECT src AS id, src AS t FROM r UNION SELECT w.id, r.dst FROM w JOIN r ON r.src = w.t) SELECT id AS node, min(t) AS component FROM w GROUP BY id")
def _(c):
    return connected_components(c.photos.filter("id <> base").select(F.col("id").alias("src"), F.col("base").alias("dst")))


@query("d9_d11_find_duplicates", f"WITH RECURSIVE {FP}, {KEYS}, {SCORE}, {GROUPS}, {BEST} {TOTALS}")
def _(c):
    return dup.find_duplicates(prints(c))


@query("d10_exact_groups", f"WITH RECURSIVE {FP}, {KEYS}, {SCORE}, {GROUPS}, {BEST}, t AS ({TOTALS}) SELECT is_exact OR confidence >= 99 AS exact, count(*) AS n_groups, CAST(sum(recoverable_bytes) AS BIGINT) AS recoverable_bytes, CAST(sum(n - 1) AS BIGINT) AS n_copies FROM t GROUP BY 1")
def _(c):
    exact = F.col("is_exact") | (F.col("confidence") >= 99)
    return dup.find_duplicates(prints(c)).groupBy(exact.alias("exact")).agg(F.count("*").alias("n_groups"), F.sum("recoverable_bytes").alias("recoverable_bytes"), F.sum(F.col("n") - 1).alias("n_copies"))


@query("a16_duplicate_totals", f"WITH RECURSIVE {FP}, {KEYS}, {SCORE}, {GROUPS}, {BEST}, t AS ({TOTALS}) SELECT CASE WHEN is_video THEN 'video' WHEN is_exact OR confidence >= 99 THEN 'exact' ELSE 'similar' END AS kind, count(*) AS n_groups, CAST(sum(n - 1) AS BIGINT) AS n_copies, CAST(sum(total_bytes - recoverable_bytes) AS BIGINT) AS master_bytes, CAST(sum(recoverable_bytes) AS BIGINT) AS recoverable_bytes FROM t GROUP BY 1")
def _(c):
    return dup.duplicate_totals(dup.find_duplicates(prints(c)))


@query("d15_new_pairs", f"WITH {FP}, {KEYS.split(chr(10) + 's AS')[0].rstrip().rstrip(',')} SELECT DISTINCT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM k x JOIN k y ON x.key = y.key AND x.id <> y.id WHERE x.id % 10 = 2")
def _(c):
    fp = prints(c)
    return dup.new_pairs(fp.filter("id % 10 = 2"), dup.blocking_keys(fp.filter("id % 10 <> 2")))


@query("d12_redundant_ids", f"WITH RECURSIVE {FP}, {KEYS}, {SCORE}, {GROUPS}, {BEST} SELECT id, group_id FROM g WHERE rank > 1")
def _(c):
    return dup.groups_and_totals(prints(c))[0].filter("rank > 1").select("id", "group_id")


@query("d5_digest_links", f"WITH {FP}, s AS (SELECT id, min(id) OVER (PARTITION BY sha256) AS a, min(id) OVER (PARTITION BY partial_sha256, file_size) AS b, CASE WHEN length(cn) > 1 THEN min(id) OVER (PARTITION BY cn, ext) END AS c FROM fp) SELECT DISTINCT x AS a, id AS b FROM (SELECT id, a AS x FROM s UNION ALL SELECT id, b FROM s UNION ALL SELECT id, c FROM s) WHERE x < id")
def _(c):
    return dup.digest_links(prints(c))


EVERY = KEYS.replace("HAVING count(*) BETWEEN 2 AND CASE fam WHEN 'size' THEN 1000 WHEN 'digest' THEN 1000 WHEN 'band' THEN 30 WHEN 'duration' THEN 30 ELSE 25 END", "HAVING count(*) >= 2")


@query("d5_complete_groups", f"WITH RECURSIVE {FP}, {EVERY}, {SCORE}, {GROUPS}, {BEST} SELECT id, group_id, rank FROM g")
def _(c):
    return dup.complete_groups(prints(c)).select("id", "group_id", F.col("rank").cast("long").alias("rank"))


@query("d15_incremental_groups", f"WITH RECURSIVE {FP}, {EVERY}, {SCORE}, {GROUPS} SELECT id, group_id FROM m")
def _(c):
    fp = written(prints(c), "fingerprints")
    fresh, stored = fp.filter("id % 10 = 2"), fp.filter("id % 10 <> 2")
    links = dup.complete_links(stored).union(dup.new_links(dup.keyed_looks(fresh), dup.keyed_looks(stored)))
    return connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("id"), F.col("component").alias("group_id"))


def values(rows) -> str:
    lit = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


HAV = "6371000.0::DOUBLE * 2 * atan2(sqrt(h), sqrt(1 - h))"
PLACES = f"pl(kind, ord, name, city, plat, plon, radius) AS (VALUES {values((k, i, p.name, p.city, p.lat, p.lon, float(p.radius_m)) for k, own in enumerate((places.LANDMARKS, places.CITIES)) for i, p in enumerate(own))})"
GEO = f"""x AS (SELECT photo_id, gps_lat, gps_lon FROM {{exif}} WHERE gps_lat IS NOT NULL), hd AS (SELECT x.*, pl.*, pow(sin(radians(plat::DOUBLE - gps_lat) / 2), 2) + cos(radians(gps_lat)) * cos(radians(plat::DOUBLE)) * pow(sin(radians(plon::DOUBLE - gps_lon) / 2), 2) AS h FROM x, pl),
q AS (SELECT *, {HAV} AS m, CASE WHEN kind = 0 AND {HAV} <= radius THEN 95 WHEN kind = 1 AND {HAV} <= radius THEN 85 WHEN kind = 1 AND {HAV} <= 120000 THEN 70 END AS score FROM hd),
geo AS (SELECT photo_id, city, CASE WHEN kind = 0 THEN name END AS landmark, CASE WHEN kind = 0 THEN city || ' • ' || name ELSE city END AS location_name, score AS confidence FROM q WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY score DESC, m, ord) = 1)"""


@query("j6_reverse_geocode", f"WITH {PLACES}, {GEO} SELECT x.photo_id, coalesce(g.city, 'GPS') AS city, landmark, coalesce(confidence, 60) AS confidence FROM x LEFT JOIN geo g ON g.photo_id = x.photo_id")
def _(c):
    out = places.reverse_geocoded(c.exif.filter("gps_lat is not null"))
    return out.select("photo_id", F.when(F.col("confidence") == 60, "GPS").otherwise(F.col("city")).alias("city"), "landmark", "confidence")


@query("j7_haversine", "SELECT photo_id, round(6371.0::DOUBLE * 2 * atan2(sqrt(h), sqrt(1 - h)), 3) AS km FROM (SELECT photo_id, pow(sin(radians(28.6139 - gps_lat) / 2), 2) + cos(radians(gps_lat)) * cos(radians(28.6139)) * pow(sin(radians(77.2090 - gps_lon) / 2), 2) AS h FROM {exif} WHERE gps_lat IS NOT NULL)")
def _(c):
    from shutterlake.functions.scalars import haversine_m

    return c.exif.filter("gps_lat is not null").select("photo_id", F.round(haversine_m(F.col("gps_lat"), F.col("gps_lon"), F.lit(28.6139), F.lit(77.2090)) / 1000, 3).alias("km"))


#: Every document, with a sentence after it that depends on its id.
SAID = "text || CASE doc_id % 9 WHEN 0 THEN ' We saw the Taj Mahal.' WHEN 1 THEN ' Welcome to Pune' WHEN 2 THEN ' pune and agra' WHEN 3 THEN ' Lahori Gate, Red Fort Agra' WHEN 4 THEN ' metro to New York' ELSE '' END"
WORDS = values([(i, p.city, p.name, "\\b(" + "|".join(p.keywords) + ")\\b") for i, p in enumerate(places.LANDMARKS)])
TOWNS = values([(100 + i, p.city, "\\b" + p.name.lower() + "\\b") for i, p in enumerate(places.CITIES)])


@query("j8_place_from_text", f"""WITH t AS (SELECT doc_id, lower({SAID}) AS low FROM documents), l(ord, city, landmark, pat) AS (VALUES {WORDS}), n(ord, city, pat) AS (VALUES {TOWNS}),
h AS (SELECT doc_id, ord, city, landmark, 90 AS confidence FROM t, l WHERE regexp_matches(low, pat) UNION ALL SELECT doc_id, ord, city, NULL, 75 FROM t, n WHERE regexp_matches(low, pat) AND regexp_matches(low, '{"|".join(places.CLUES)}'))
SELECT doc_id, city, landmark, confidence FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord) = 1""")
def _(c):
    out = c.documents.select("doc_id", places.place_from_text(F.expr(SAID)).alias("x")).filter("x is not null")
    return out.select("doc_id", "x.city", "x.landmark", "x.confidence")


def placed(c: Catalog):
    return c.photos.filter("not is_trashed").select("id", "filename", "created_at", "extracted_text").join(c.exif.select(F.col("photo_id").alias("id"), "gps_lat", "gps_lon"), "id", "left")


ANCHORS = f"""{PLACES}, {GEO}, a AS (SELECT p.id, p.filename, p.created_at, CAST(p.created_at AS DATE) AS day, e.gps_lat AS lat, e.gps_lon AS lon, CASE WHEN e.gps_lat IS NOT NULL THEN coalesce(g.location_name, 'GPS') END AS loc, CASE WHEN e.gps_lat IS NOT NULL THEN coalesce(g.city, 'GPS') END AS city, e.gps_lat IS NOT NULL AS anchor
  FROM {{photos}} p LEFT JOIN {{exif}} e ON e.photo_id = p.id LEFT JOIN geo g ON g.photo_id = p.id WHERE NOT is_trashed),
s0 AS (SELECT *, CASE WHEN epoch(created_at) - epoch(lag(created_at) OVER o) <= 12600 THEN 0 ELSE 1 END AS new FROM a WINDOW o AS (PARTITION BY day ORDER BY created_at, id)), s1 AS (SELECT *, sum(new) OVER (PARTITION BY day ORDER BY created_at, id) AS session FROM s0),
pop AS (SELECT day, session, loc, city, count(*) AS n, min((created_at, id)) AS first FROM s1 WHERE anchor GROUP BY ALL), top AS (SELECT * FROM pop QUALIFY row_number() OVER (PARTITION BY day, session ORDER BY n DESC, first) = 1),
mean AS (SELECT day, session, avg(lat) AS mlat, avg(lon) AS mlon FROM s1 WHERE anchor GROUP BY ALL),
s2 AS (SELECT s1.id, filename, created_at, s1.day, anchor, coalesce(s1.loc, top.loc) AS loc, coalesce(s1.city, top.city) AS city, coalesce(lat, mlat) AS lat, coalesce(lon, mlon) AS lon, CASE WHEN anchor THEN 90 WHEN top.loc IS NOT NULL THEN 80 END AS confidence FROM s1 LEFT JOIN top ON top.day = s1.day AND top.session = s1.session LEFT JOIN mean ON mean.day = s1.day AND mean.session = s1.session)"""
DAYS = """dc AS (SELECT day, min(city) AS dcity FROM s2 WHERE anchor GROUP BY 1 HAVING min(city) = max(city)), dm AS (SELECT day, avg(lat) AS mlat FROM s2 WHERE lat IS NOT NULL GROUP BY 1),
s3 AS (SELECT s2.id, filename, created_at, anchor, coalesce(loc, dcity) AS loc, coalesce(city, dcity) AS city, CASE WHEN loc IS NULL THEN mlat ELSE lat END AS lat, CASE WHEN loc IS NULL AND dcity IS NOT NULL THEN 75 ELSE confidence END AS confidence FROM s2 LEFT JOIN dc ON dc.day = s2.day LEFT JOIN dm ON dm.day = dc.day)"""
NUMS = """nn AS (SELECT *, TRY_CAST(nullif(regexp_extract(filename, '(?i)IMG_([0-9]+)[.]', 1), '') AS BIGINT) AS num FROM s3), near AS (SELECT t.id, m.loc, m.city, m.lat FROM nn t JOIN nn m ON m.anchor AND m.num IS NOT NULL AND t.loc IS NULL AND abs(t.num - m.num) <= 35 QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY abs(t.num - m.num), m.created_at, m.id) = 1)"""


@query("g2_w5_session_propagate", f"WITH {ANCHORS} SELECT id, loc AS location_name, round(lat, 5) AS lat FROM s2 WHERE confidence = 80")
def _(c):
    out = loc.session_propagated(named_gps(loc.anchors(placed(c))))
    return out.filter("confidence = 80").select("id", "location_name", F.round("lat", 5).alias("lat"))


def named_gps(df):
    """Places that are only coordinates, all under one name, as the DuckDB forms have them."""
    only = F.col("confidence") == 60
    return df.withColumns({"location_name": F.when(only, "GPS").otherwise(F.col("location_name")), "city": F.when(only, "GPS").otherwise(F.col("city"))})


@query("g4_propagate_locations", f"WITH {ANCHORS}, {DAYS}, {NUMS} SELECT nn.id, coalesce(nn.loc, near.loc) AS location_name, round(CASE WHEN nn.loc IS NULL THEN near.lat ELSE nn.lat END, 5) AS lat, CASE WHEN nn.loc IS NULL THEN 70 WHEN anchor THEN 90 ELSE nn.confidence END AS confidence, NOT anchor AS is_inferred FROM nn LEFT JOIN near ON near.id = nn.id WHERE coalesce(nn.loc, near.loc) IS NOT NULL")
def _(c):
    out = loc.sequence_propagated(loc.day_propagated(loc.session_propagated(named_gps(loc.anchors(placed(c))))))
    return out.filter("location_name is not null").select("id", "location_name", F.round("lat", 5).alias("lat"), F.when(F.col("is_anchor"), 90).otherwise(F.col("confidence")).alias("confidence"), (~F.col("is_anchor")).alias("is_inferred"))


@query("j10_match_trip", """WITH t AS (SELECT row_number() OVER (ORDER BY first_day, last_day, c) AS trip_id, first_day, last_day FROM (SELECT source_folder_path AS c, month(created_at) AS m, year(created_at) AS y, CAST(min(created_at) AS DATE) AS first_day, CAST(max(created_at) AS DATE) AS last_day FROM {photos} WHERE id % 9 = 0 GROUP BY ALL))
SELECT p.id, min(t.trip_id) AS trip_id FROM {photos} p JOIN t ON CAST(p.created_at AS DATE) BETWEEN t.first_day AND t.last_day GROUP BY 1""")
def _(c):
    from pyspark.sql import Window

    runs = c.photos.filter("id % 9 = 0").groupBy("source_folder_path", F.month("created_at"), F.year("created_at")).agg(F.to_date(F.min("created_at")).alias("first_day"), F.to_date(F.max("created_at")).alias("last_day"))
    trips = runs.select(F.row_number().over(Window.orderBy("first_day", "last_day", "source_folder_path")).alias("trip_id"), "first_day", "last_day")  # a few rows a folder
    return loc.matched_trips(c.photos.select("id", F.to_date("created_at").alias("day")), trips)
