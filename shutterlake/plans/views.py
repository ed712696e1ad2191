"""A media catalogue derived from the driver's tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.sources.tables import read_table

#: In order, as later views use earlier ones. {name} stands for a table or view.
VIEWS = {
    "photos": """
SELECT id, base, filename, folder || '/' || filename AS file_path, folder AS source_folder_path,
  CASE WHEN kind = 4 THEN 'video/mp4' WHEN kind = 3 THEN 'image/png' WHEN kind = 5 THEN 'application/pdf' WHEN kind = 7 THEN 'image/webp' WHEN kind >= 8 THEN 'image/x-nikon-nef' ELSE 'image/jpeg' END AS mime_type,
  CASE base % 4 WHEN 0 THEN 4032 WHEN 1 THEN 1920 WHEN 2 THEN 1080 ELSE 1170 END AS width,
  CASE base % 4 WHEN 0 THEN 3024 WHEN 1 THEN 1080 WHEN 2 THEN 1080 ELSE 2532 END AS height,
  base * 977 % 90000000 + 1000 AS file_size, created_at,
  id % 11 = 0 AS is_favorite, id % 29 = 0 AS is_archived, id % 23 = 0 AS is_trashed, id % 31 = 0 AS is_locked, id % 13 = 0 AS faces_scanned,
  CASE WHEN id % 7 = 0 THEN CAST(-1 AS DOUBLE) ELSE price - floor(price / 400) * 400 END AS blur_score,
  CASE WHEN id % 19 = 0 THEN '' WHEN id % 19 = 1 THEN md5('p' || CAST(base AS VARCHAR(20))) WHEN id % 19 = 2 THEN repeat('0', 64) ELSE md5('p' || CAST(base AS VARCHAR(20))) || md5('q' || CAST(base AS VARCHAR(20))) END AS perceptual_hash,
  CASE WHEN id % 17 = 0 THEN 'description of ' || CAST(id AS VARCHAR(20)) END AS description,
  CASE WHEN c % 4 = 0 THEN 'Agra' WHEN c % 4 = 1 THEN 'Unknown Location' WHEN c % 4 = 2 THEN '' END AS location_name,
  kind = 5 AS is_document, CASE WHEN kind = 5 THEN CASE WHEN id % 24 < 12 THEN 'Invoices' ELSE 'Receipts' END END AS document_category,
  CASE WHEN kind = 5 THEN 'invoice number ' || CAST(id AS VARCHAR(20)) WHEN id % 6 = 0 THEN 'ERROR' ELSE '' END AS extracted_text
FROM (
  SELECT id, c, price, kind, base, created_at, '/lib/c' || CAST(c % 20 AS VARCHAR(20)) AS folder,
    CASE kind WHEN 0 THEN 'IMG_' || n || '.JPG' WHEN 1 THEN 'IMG_' || b || ' - Copy.JPG' WHEN 2 THEN 'IMG-20240101-WA' || n || '.jpg' WHEN 3 THEN 'Screenshot_20240102-1' || n || '.png'
      WHEN 4 THEN 'VID_' || n || '.mp4' WHEN 5 THEN 'scan_invoice_' || n || '.pdf' WHEN 6 THEN 'snapseed_' || n || '.jpeg' WHEN 7 THEN 'sticker_' || n || '.webp' ELSE 'DSC' || n || '.NEF' END AS filename
  FROM (
    SELECT id, c, price, id % 12 AS kind, base, created_at, lpad(CAST(id AS VARCHAR(20)), 6, '0') AS n, lpad(CAST(base AS VARCHAR(20)), 6, '0') AS b
    FROM (
      SELECT o_orderkey AS id, o_custkey AS c, o_totalprice AS price, CASE WHEN o_orderkey % 10 IN (1, 2) THEN o_orderkey - o_orderkey % 10 ELSE o_orderkey END AS base,
        o_orderdate + INTERVAL '1' SECOND * (o_orderkey * 7919 % 86400) AS created_at
      FROM {orders}
    ) x
  ) y
) z""",
    "media": """
SELECT id, filename, folder || '/' || filename AS file_path, width, height, file_size, make, CASE WHEN make IS NOT NULL AND id % 2 = 0 THEN 'Model 1' END AS model, has_exif, gps_lat, gps_lon,
  CASE WHEN id % 10 = 3 THEN 'made by the Snipping Tool' WHEN id % 10 = 4 THEN 'com.apple.NSScreenshot' END AS software, id % 61 = 0 AS os_native, id % 59 = 0 AS metadata_failed,
  CASE WHEN id % 8 = 0 THEN CAST(2.8 AS DOUBLE) WHEN id % 8 = 1 THEN CAST(0 AS DOUBLE) END AS f_number, CASE WHEN id % 9 = 0 THEN CAST(200 AS DOUBLE) END AS iso, CASE WHEN id % 11 = 0 THEN '1/200' END AS exposure_time,
  CASE WHEN id % 6 = 0 THEN 'Apple' END AS video_make, CAST(NULL AS VARCHAR(9)) AS video_model, CAST(id % 4 * 700000 AS DOUBLE) AS bit_rate,
  CASE id % 3 WHEN 0 THEN CAST(848 AS DOUBLE) WHEN 1 THEN CAST(480 AS DOUBLE) ELSE CAST(1920 AS DOUBLE) END AS video_width, CASE id % 3 WHEN 0 THEN CAST(480 AS DOUBLE) WHEN 1 THEN CAST(848 AS DOUBLE) ELSE CAST(1080 AS DOUBLE) END AS video_height,
  CASE id % 9 WHEN 0 THEN 'Good morning, have a blessed day my friends' WHEN 1 THEN 'a joke' WHEN 2 THEN 'nothing that anybody would ever repeat' WHEN 3 THEN '' END AS extracted_text,
  CASE WHEN id % 7 = 0 THEN NULL WHEN id % 7 = 1 THEN CAST(-1 AS DOUBLE) ELSE CAST(id % 500 AS DOUBLE) END AS blur_score, mime_type
FROM (
  SELECT o_orderkey AS id,
    CASE o_custkey % 17 WHEN 0 THEN '/lib/WhatsApp/Media/WhatsApp Images' WHEN 1 THEN '/lib/Instagram' WHEN 2 THEN '/lib/Snapchat' WHEN 3 THEN '/lib/LinkedIn' WHEN 4 THEN '/lib/VSCO' WHEN 5 THEN '/lib/Downloads' WHEN 6 THEN '/lib/Telegram' WHEN 7 THEN '/lib/Screen Recordings'
      WHEN 8 THEN '/lib/Captures' WHEN 9 THEN '/lib/Screenshots' WHEN 10 THEN '/lib/TikTok' WHEN 11 THEN '/lib/Canva' WHEN 12 THEN '/lib/ig' ELSE '/lib/DCIM' END AS folder,
    CASE o_orderkey % 53 WHEN 0 THEN 'IMG-20240101-WA0001.jpg' WHEN 1 THEN 'VID-20240101-WA0002.mp4' WHEN 2 THEN 'WhatsApp Image 2024-01-02 at 10.jpeg' WHEN 3 THEN 'WA-1234.jpg' WHEN 4 THEN 'AAWT0024.JPG' WHEN 5 THEN '123456789_12345678901_12345678901_n.jpg' WHEN 6 THEN 'reels_1.mp4'
      WHEN 7 THEN 'Snapchat-12345.jpg' WHEN 8 THEN 'snap_9.png' WHEN 9 THEN 'linkedin_post.png' WHEN 10 THEN 'my linkedin photo.jpg' WHEN 11 THEN 'Untitled design (3).png' WHEN 12 THEN 'snapseed-01.jpeg' WHEN 13 THEN 'beach_edited.jpg' WHEN 14 THEN 'download (2).png'
      WHEN 15 THEN 'company-logo.png' WHEN 16 THEN 'chrome_1.webp' WHEN 17 THEN 'photo_2024-01-02_10-11-12.jpg' WHEN 18 THEN 'video_2024-01-02_10-11-12.mp4' WHEN 19 THEN 'received_1234567.jpeg' WHEN 20 THEN 'RDT_20240101.jpg' WHEN 21 THEN 'twitter-1.jpg' WHEN 22 THEN 'tiktok1.mp4'
      WHEN 23 THEN '0123456789abcdef0123.jpg' WHEN 24 THEN '01234567-89ab-cdef-0123-456789abcdef.png' WHEN 25 THEN 'IMG_1234.HEIC' WHEN 26 THEN 'IMG_E1234.JPG' WHEN 27 THEN 'DSC_1234.NEF' WHEN 28 THEN 'sticker.webp' WHEN 29 THEN 'Screenshot 2026-08-16 193021.png'
      WHEN 30 THEN 'Screenshot_20260816-193021.png' WHEN 31 THEN 'Screen Shot 2026-08-16 at 7.30.21 PM.png' WHEN 32 THEN 'phone screenshot.jpg' WHEN 33 THEN 'screen_recording_1.mp4' WHEN 34 THEN 'clip.mov' WHEN 35 THEN 'picture.png' WHEN 36 THEN 'picture.webp' WHEN 37 THEN 'family.jpg'
      WHEN 38 THEN 'holiday-copy.png' WHEN 39 THEN 'holiday (2).heic' WHEN 40 THEN 'notes.pdf' WHEN 41 THEN '1234567890123.jpg' WHEN 42 THEN 'archive.zip' WHEN 43 THEN 'film.mkv' WHEN 44 THEN 'stock-icon.gif' WHEN 45 THEN 'vsco12.jpg' WHEN 46 THEN 'portrait_PXL.cr2' WHEN 47 THEN 'scan.tif'
      WHEN 48 THEN 'screen-shot.final.jpg' WHEN 49 THEN 'snip.png' WHEN 50 THEN 'PORTRAIT_1234.jpg' WHEN 51 THEN 'IMG_01234.jpg' ELSE 'DCIM0001.dng' END AS filename,
    CASE o_orderkey % 13 WHEN 0 THEN 4032 WHEN 1 THEN 1080 WHEN 2 THEN 1600 WHEN 3 THEN 3024 WHEN 4 THEN 1620 WHEN 5 THEN 2732 WHEN 6 THEN 300 WHEN 7 THEN 2500 WHEN 8 THEN 720 WHEN 9 THEN 0 WHEN 10 THEN NULL WHEN 11 THEN 512 ELSE 1170 END AS width,
    CASE o_orderkey % 13 WHEN 0 THEN 3024 WHEN 1 THEN 1080 WHEN 2 THEN 900 WHEN 3 THEN 1964 WHEN 4 THEN 2160 WHEN 5 THEN 2048 WHEN 6 THEN 200 WHEN 7 THEN 900 WHEN 8 THEN 1280 WHEN 9 THEN 0 WHEN 10 THEN 700 WHEN 11 THEN 512 ELSE 2532 END AS height,
    CASE o_orderkey % 7 WHEN 0 THEN CAST(0 AS BIGINT) WHEN 1 THEN CAST(100000 AS BIGINT) WHEN 2 THEN CAST(254000 AS BIGINT) WHEN 3 THEN CAST(290000 AS BIGINT) WHEN 4 THEN NULL ELSE o_orderkey * 977 % 9000000 END AS file_size,
    CASE WHEN o_orderkey % 5 = 0 THEN 'Canon' WHEN o_orderkey % 5 = 1 THEN ' ' END AS make, o_orderkey % 5 IN (0, 2) AS has_exif,
    CASE WHEN o_orderkey % 19 = 0 THEN CAST(27.1 AS DOUBLE) WHEN o_orderkey % 19 = 1 THEN CAST(0 AS DOUBLE) END AS gps_lat, CASE WHEN o_orderkey % 19 = 0 THEN CAST(78.1 AS DOUBLE) END AS gps_lon,
    CASE o_orderkey % 6 WHEN 0 THEN 'image/PNG' WHEN 1 THEN 'image/heic' WHEN 2 THEN 'image/tiff' WHEN 3 THEN 'image/x-raw' WHEN 4 THEN 'image/jpeg' ELSE NULL END AS mime_type
  FROM {orders}
) m""",
    "exif": """
SELECT o_orderkey AS photo_id, CASE WHEN o_orderkey % 12 IN (2, 3, 5, 6, 7) THEN NULL WHEN o_orderpriority < '3' THEN 'Canon' ELSE 'Nikon' END AS make,
  CASE WHEN o_orderkey % 12 IN (2, 3, 5, 6, 7) THEN NULL ELSE 'Model ' || o_orderpriority END AS model,
  CASE WHEN o_custkey % 5 = 0 THEN CASE o_custkey % 3 WHEN 0 THEN CAST(27.1751 AS DOUBLE) WHEN 1 THEN CAST(28.6129 AS DOUBLE) ELSE CAST(48.8584 AS DOUBLE) END + CAST(o_orderkey % 41 - 20 AS DOUBLE) * CAST(0.002 AS DOUBLE) END AS gps_lat,
  CASE WHEN o_custkey % 5 = 0 THEN CASE o_custkey % 3 WHEN 0 THEN CAST(78.0421 AS DOUBLE) WHEN 1 THEN CAST(77.2295 AS DOUBLE) ELSE CAST(2.2945 AS DOUBLE) END + CAST(o_orderkey % 37 - 18 AS DOUBLE) * CAST(0.002 AS DOUBLE) END AS gps_lon
FROM {orders} WHERE o_orderkey % 14 <> 13""",
    "fingerprints": """
SELECT id AS photo_id, base, md5('a' || k) || md5('b' || k) AS sha256, md5('q' || k) AS partial_sha256,
  CASE WHEN id % 16 = 15 THEN '' ELSE substr(md5('d' || b) || md5('e' || b), 1, 63) || substr('0123456789abcdef', CAST(id % 16 AS INTEGER) + 1, 1) END AS dhash,
  substr(md5('p' || b), 1, 16) AS phash, CASE WHEN id % 12 = 4 THEN CAST(base % 300 AS DOUBLE) + CAST(0.5 AS DOUBLE) END AS video_duration
FROM (SELECT *, CAST(CASE WHEN id % 10 = 2 THEN id ELSE base END AS VARCHAR(20)) AS k, CAST(base AS VARCHAR(20)) AS b FROM {photos}) x WHERE id % 18 <> 17""",
    "people": """
SELECT s.s_suppkey AS id, CASE WHEN s.s_suppkey % 3 = 0 THEN 'Unknown Person' ELSE s.s_name END AS name, c.cover_photo_id, s.s_suppkey % 10 = 0 AS is_favorite
FROM {supplier} s LEFT JOIN (SELECT l_suppkey, min(l_orderkey) AS cover_photo_id FROM {lineitem} GROUP BY l_suppkey) c ON c.l_suppkey = s.s_suppkey""",
    "photo_people": "SELECT DISTINCT l_orderkey AS photo_id, l_suppkey AS person_id FROM {lineitem} WHERE l_linenumber <= 2",
    "tags": "SELECT row_number() OVER (ORDER BY name) AS id, name FROM (SELECT DISTINCT p_type AS name FROM {part}) x",
    "photo_tags": "SELECT DISTINCT l.l_orderkey AS photo_id, t.id AS tag_id FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey JOIN {tags} t ON t.name = p.p_type WHERE l.l_linenumber = 1",
    "albums": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_nationkey * 40 AS BIGINT) AS cover_photo_id, CAST(n_regionkey AS BIGINT) AS updated_at FROM {nation}",
    "album_photos": """
SELECT CAST(c.c_nationkey AS BIGINT) AS album_id, o.o_orderkey AS photo_id, row_number() OVER (PARTITION BY c.c_nationkey ORDER BY o.o_orderdate, o.o_orderkey) AS position
FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey""",
    "folders": "SELECT row_number() OVER (ORDER BY folder_path) AS id, folder_path FROM (SELECT DISTINCT source_folder_path AS folder_path FROM {photos} WHERE id % 3 <> 1) x",
    "disk": """
SELECT file_path AS path, file_size AS length FROM {photos} WHERE id % 17 <> 0
UNION ALL SELECT source_folder_path || '/new_' || CAST(id AS VARCHAR(20)) || '.jpg', file_size FROM {photos} WHERE id % 100 = 0
UNION ALL SELECT source_folder_path || '/new_' || CAST(id AS VARCHAR(20)) || CASE id % 3 WHEN 0 THEN '.HEIC' WHEN 1 THEN '.mov' ELSE '.cr2' END, file_size FROM {photos} WHERE id % 70 < 2
UNION ALL SELECT source_folder_path || '/notes_' || CAST(id AS VARCHAR(20)) || '.zip', file_size FROM {photos} WHERE id % 50 = 0""",
    "faces": "SELECT vec_id AS id, vec_id AS photo_id, CAST(label AS BIGINT) AS person_id, embedding AS descriptor FROM {embeddings}",
}
TABLES = ("orders", "lineitem", "customer", "supplier", "part", "nation", "events", "embeddings", "documents", "labels", "benchmark")


class Catalog:
    """The views over one folder of tables, each made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.made.setdefault(name, read_table(self.spark, self.sf_dir, name))
        if name not in VIEWS:
            raise AttributeError(name)
        if name not in self.made:
            text = VIEWS[name]
            used = {x: getattr(self, x) for x in (*TABLES, *VIEWS) if "{" + x + "}" in text}
            self.made[name] = self.spark.sql(text, **used)
        return self.made[name]

    @cached_property
    def photos(self) -> DataFrame:
        text = VIEWS["photos"]
        return self.spark.sql(text, orders=self.orders).withColumn("created_at", F.col("created_at").cast("timestamp"))


def duckdb_sql(body: str) -> str:
    """``body`` with the views that it names in {braces} before it, for DuckDB."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if "{" + name + "}" in text and name not in needed:
                need(VIEWS[name])
                needed.append(name)

    need(body)
    plain = lambda text: re.sub(r"\{([a-z_]+)\}", r"\1", text)
    views = ",\n".join(f"{name} AS ({plain(VIEWS[name])})" for name in needed)
    body = plain(body).strip()
    if not views:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{body[15:]}"
    return f"WITH {views},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {views}\n{body}"
