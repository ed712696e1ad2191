"""Files as tables: listings, media types, catalogue rows, pixels and manifests."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shutterlake.functions import pixels
from shutterlake.functions.pixels import shrunk

#: Kind and media type by extension.
REGISTRY = {
    "jpg": ("photo", "image/jpeg"),
    "jpeg": ("photo", "image/jpeg"),
    "jfif": ("photo", "image/jpeg"),
    "png": ("photo", "image/png"),
    "heic": ("photo", "image/heic"),
    "heif": ("photo", "image/heif"),
    "tiff": ("photo", "image/tiff"),
    "tif": ("photo", "image/tiff"),
    "webp": ("photo", "image/webp"),
    "avif": ("photo", "image/avif"),
    "jxl": ("photo", "image/jxl"),
    "bmp": ("photo", "image/bmp"),
    "gif": ("photo", "image/gif"),
    "jp2": ("photo", "image/jp2"),
    "j2k": ("photo", "image/jp2"),
    "jpf": ("photo", "image/jp2"),
    "jpx": ("photo", "image/jp2"),
    "jxr": ("photo", "image/jxr"),
    "wdp": ("photo", "image/vnd.ms-photo"),
    "hdp": ("photo", "image/vnd.ms-photo"),
    "svg": ("photo", "image/svg+xml"),
    "cr2": ("raw", "image/x-canon-cr2"),
    "cr3": ("raw", "image/x-canon-cr3"),
    "crw": ("raw", "image/x-canon-crw"),
    "nef": ("raw", "image/x-nikon-nef"),
    "nrw": ("raw", "image/x-nikon-nrw"),
    "arw": ("raw", "image/x-sony-arw"),
    "sr2": ("raw", "image/x-sony-sr2"),
    "srf": ("raw", "image/x-sony-srf"),
    "dng": ("raw", "image/x-adobe-dng"),
    "orf": ("raw", "image/x-olympus-orf"),
    "raf": ("raw", "image/x-fuji-raf"),
    "rw2": ("raw", "image/x-panasonic-rw2"),
    "pef": ("raw", "image/x-pentax-pef"),
    "ptx": ("raw", "image/x-pentax-ptx"),
    "srw": ("raw", "image/x-samsung-srw"),
    "x3f": ("raw", "image/x-sigma-x3f"),
    "rwl": ("raw", "image/x-leica-rwl"),
    "raw": ("raw", "image/x-panasonic-raw"),
    "mrw": ("raw", "image/x-minolta-mrw"),
    "3fr": ("raw", "image/x-hasselblad-3fr"),
    "fff": ("raw", "image/x-hasselblad-fff"),
    "iiq": ("raw", "image/x-phaseone-iiq"),
    "cap": ("raw", "image/x-phaseone-cap"),
    "kdc": ("raw", "image/x-kodak-kdc"),
    "dcr": ("raw", "image/x-kodak-dcr"),
    "k25": ("raw", "image/x-kodak-k25"),
    "erf": ("raw", "image/x-epson-erf"),
    "gpr": ("raw", "image/x-gopro-gpr"),
    "mef": ("raw", "image/x-mamiya-mef"),
    "bay": ("raw", "image/x-casio-bay"),
    "sti": ("raw", "image/x-sinar-sti"),
    "mos": ("raw", "image/x-leaf-mos"),
    "mov": ("video", "video/quicktime"),
    "mp4": ("video", "video/mp4"),
    "m4v": ("video", "video/x-m4v"),
    "avi": ("video", "video/x-msvideo"),
    "wmv": ("video", "video/x-ms-wmv"),
    "asf": ("video", "video/x-ms-asf"),
    "mkv": ("video", "video/x-matroska"),
    "webm": ("video", "video/webm"),
    "3gp": ("video", "video/3gpp"),
    "3g2": ("video", "video/3gpp2"),
    "dv": ("video", "video/x-dv"),
    "vob": ("video", "video/x-ms-vob"),
    "mpg": ("video", "video/mpeg"),
    "mpeg": ("video", "video/mpeg"),
    "mp2": ("video", "video/mpeg"),
    "f4v": ("video", "video/x-f4v"),
    "flv": ("video", "video/x-flv"),
    "ogv": ("video", "video/ogg"),
    "ogg": ("video", "video/ogg"),
    "m2t": ("video", "video/mp2t"),
    "mts": ("video", "video/mp2t"),
    "m2ts": ("video", "video/mp2t"),
    "rm": ("video", "video/vnd.rn-realvideo"),
    "rmvb": ("video", "video/vnd.rn-realvideo"),
    "divx": ("video", "video/divx"),
    "xvid": ("video", "video/x-xvid"),
    "braw": ("cinema", "video/x-braw"),
    "r3d": ("cinema", "video/x-r3d"),
    "ari": ("cinema", "video/x-arri-ari"),
    "arx": ("cinema", "video/x-arri-arx"),
    "crm": ("cinema", "video/x-canon-crm"),
    "mxf": ("cinema", "application/mxf"),
    "cine": ("cinema", "video/x-phantom-cine"),
    "insv": ("cinema", "video/mp4"),
    "lrv": ("cinema", "video/mp4"),
    "op1": ("cinema", "application/mxf"),
    "op2": ("cinema", "application/mxf"),
    "dnxhd": ("cinema", "video/x-dnxhd"),
    "fcpvid": ("cinema", "video/quicktime"),
    "pdf": ("document", "application/pdf"),
    "txt": ("document", "text/plain"),
    "doc": ("document", "application/msword"),
    "docx": ("document", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
}


def media_type(path: Column) -> Column:
    """``struct(ext, kind, mime, supported)`` of a path. An extension that nobody knows counts as a JPEG."""
    ext = F.lower(F.regexp_extract(F.trim(path), r"\.([^./\\]*)$", 1))
    table = F.create_map(*[F.lit(x) for e, (k, m) in REGISTRY.items() for x in (e, f"{k} {m}")])
    found = F.try_element_at(table, ext)
    return F.struct(ext.alias("ext"), F.split_part(found, F.lit(" "), F.lit(1)).alias("kind"), F.coalesce(F.split_part(found, F.lit(" "), F.lit(2)), F.lit("image/jpeg")).alias("mime"), found.isNotNull().alias("supported"))


def scan_media(spark: SparkSession, path: str) -> DataFrame:
    """Media files below ``path``: path, length, modificationTime. Contents aren't read; hidden folders and package folders are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return files.filter(~F.col("path").rlike(r"/(\.[^/]+|node_modules)/")).filter(media_type(F.col("path"))["supported"])


def catalog_rows(files: DataFrame) -> DataFrame:
    """Photos and camera data of files with metadata columns: created_at is the original, else the digitized, else the file's time; exposure below a second reads 1/n."""
    exposure = F.when(F.col("exposure_s") > 0, F.when(F.col("exposure_s") < 1, F.concat(F.lit("1/"), F.round(1 / F.col("exposure_s")).cast("long").cast("string"))).otherwise(F.col("exposure_s").cast("string")))
    return files.select("path", F.regexp_extract("path", r"([^/\\]*)$", 1).alias("filename"), media_type(F.col("path"))["mime"].alias("mime_type"), F.coalesce("taken_at", "digitized_at", "modified_at").alias("created_at"), exposure.alias("exposure_time"))


def assigned_folders(files: DataFrame, folders: DataFrame) -> DataFrame:
    """``files(path)`` with ``source_folder_path``: the first by id of ``folders(id, folder_path)`` above it, else its own folder. Folders above each distinct parent are listed, so the join is an equi-join and a top folder meets parents, not files."""
    own = files.withColumn("_parent", F.regexp_replace("path", r"[/\\][^/\\]*$", ""))
    parts = F.split("_parent", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    parents = own.select("_parent").distinct().select("_parent", F.explode(above).alias("folder_path"))
    hits = parents.join(folders, "folder_path").groupBy("_parent").agg(F.min_by("folder_path", "id").alias("_known"))
    return own.join(hits, "_parent", "left").select(*files.columns, F.coalesce("_known", "_parent").alias("source_folder_path"))


def content_digests(files: DataFrame, head: int = 65536) -> DataFrame:
    """``files(path, content)`` with ``sha256`` and ``partial_sha256``: of all bytes up to twice ``head``, else of the first, the size and the last ones."""
    size = F.length("content")
    ends = F.concat(F.substring(F.col("content"), 1, head), F.concat(F.lit("size_"), size.cast("string")).cast("binary"), F.substring(F.col("content"), -head, head))
    return files.withColumns({"sha256": F.sha2("content", 256), "partial_sha256": F.when(size <= 2 * head, F.sha2("content", 256)).otherwise(F.sha2(ends, 256))})


def pixel_source(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pictures: origin, height, width, channels and bytes; files that are no pictures are left out."""
    return spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")


def _bits(b: np.ndarray) -> str:
    return np.packbits(b.ravel()).tobytes().hex()


def difference_hash(grey: np.ndarray) -> str:
    grid = shrunk(grey, 16, 17)
    return _bits(grid[:, :-1] < grid[:, 1:])


def frequency_hash(corner: np.ndarray) -> str:
    """Whether each of 64 values reaches the mean of all but the first; the first bit is always set."""
    bits = corner >= corner.ravel()[1:].mean()
    bits[0, 0] = True
    return _bits(bits)


#: Columns that ``pixel_features`` makes.
FEATURES = """origin string, dhash string, ahash string, phash string, rotations array<string>, color_histogram array<double>, edge_histogram array<double>, grid binary,
blur_score double, photo_blur double, glare boolean, saturation double, white_ratio double, dark_ratio double, edge_density double, hv_ratio double, page_edges double,
outline struct<left:int,top:int,right:int,bottom:int,ratio:double,area:double,page:boolean>"""


def _features(bgr: np.ndarray) -> dict:
    grey = bgr @ np.array([0.114, 0.587, 0.299])
    small, corner = shrunk(grey, 8, 8), shrunk(grey, 32, 32)[:8, :8]
    turned = [np.rot90(grey, k) for k in (3, 2, 1)] + [grey[:, ::-1], grey[::-1]]
    page = pixels.fitted(grey, 400)
    gx, gy = map(np.abs, pixels.slopes(page))
    found = {
        "dhash": difference_hash(grey), "ahash": _bits(small >= small.mean()), "phash": frequency_hash(corner), "rotations": [difference_hash(t) for t in turned],
        "color_histogram": pixels.color_histogram(bgr).tolist(), "edge_histogram": pixels.edge_histogram(grey).tolist(), "grid": pixels.fitted_grid(grey).astype(np.uint8).tobytes(),
        "blur_score": pixels.sharpness(page)[0], "photo_blur": pixels.sharpness(shrunk(grey, 256, 256))[1], "glare": pixels.glare(page),
        "page_edges": float((gx + gy > 30).sum() / page.size), "outline": pixels.page_outline(page),
    }
    return found | pixels.document_tones(bgr, grey)


def pixel_features(images: DataFrame) -> DataFrame:
    """Of each picture of ``pixel_source``: hashes, turned and mirrored hashes, colour and edge histograms, a grid of 64 x 64 tones, sharpness (of a page, on 400 pixels, and of a photo, on 256 x 256), glare, page outline, and the tones and edges that ``document_candidate`` reads."""
    names = [f.name for f in StructType.fromDDL(FEATURES)]

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                raw = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)[:, :, :3].astype(np.float64)
                rows.append({"origin": r.origin} | _features(raw if raw.shape[2] == 3 else np.repeat(raw[:, :, :1], 3, axis=2)))
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return images.mapInPandas(features, FEATURES)


def write_manifest(plan: DataFrame, path: str) -> str:
    """``plan`` as JSON lines below ``path`` with a run id, and a totals row beside it; returns the id."""
    run = uuid.uuid4().hex
    plan.withColumn("run_id", F.lit(run)).write.mode("append").partitionBy("run_id").json(f"{path}/files")
    plan.agg(F.count("*").alias("n"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("n_bytes")).withColumns({"run_id": F.lit(run), "written_at": F.current_timestamp()}).write.mode("append").json(f"{path}/runs")
    return run


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Saved runs, newest first."""
    return spark.read.schema("run_id string, n long, n_bytes long, written_at timestamp").json(f"{path}/runs").orderBy(F.desc("written_at"), "run_id")


def synth_catalog(spark: SparkSession, n: int, now: Column) -> DataFrame:
    """``n`` rows for benchmarks: a date up to 1500 days back, every 50th a favourite."""
    i = F.col("id")
    return spark.range(n).select(i, F.concat(F.lit("photo_"), i.cast("string"), F.lit(".jpg")).alias("filename"), (now - F.make_interval(days=(i % 1500).cast("int"))).alias("created_at"), (i % 50 == 0).alias("is_favorite"), F.lit(False).alias("is_trashed"), F.lit(False).alias("is_archived"), F.lit(2450000).cast("long").alias("file_size"))
