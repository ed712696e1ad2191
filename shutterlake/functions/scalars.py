"""Scalar column functions. Each is an expression inside whole-stage code generation; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A distance that means "not comparable".
NOT_COMPARABLE = 999
#: File names that hint at a document.
DOCUMENT_NAMES = ("invoice", "receipt", "scan", "document", "doc", "bill", "ticket", "statement", "certificate", "passport", "aadhaar", "aadhar", "license", "licence", "form", "contract", "agreement", "letter", "report", "resume", "prescription", "pancard")


def hamming_hex(a: Column, b: Column) -> Column:
    """Bits that differ between hex strings of equal length; 999 if one is missing or empty, or lengths differ. Eight digits at a time, so that any length works."""
    word = lambda x, i: F.conv(F.substring(x, i * 8 + 1, 8), 16, 10).cast("long")
    words = F.transform(F.sequence(F.lit(0), F.ceil(F.length(a) / 8).cast("int") - 1), lambda i: F.bit_count(word(a, i).bitwiseXOR(word(b, i))))
    total = F.aggregate(words, F.lit(0), lambda x, y: x + y)
    return F.when((F.length(a) > 0) & (F.length(a) == F.length(b)), total).otherwise(F.lit(NOT_COMPARABLE))


def match_percent(a: Column, b: Column) -> Column:
    """Share of equal bits as a whole percentage, 75 at least; 95 where a hash is missing."""
    bits = F.length(a) * 4
    return F.when((F.coalesce(F.length(a), F.lit(0)) == 0) | (F.coalesce(F.length(b), F.lit(0)) == 0), F.lit(95)).otherwise(F.greatest(F.lit(75), F.round(100.0 * (bits - hamming_hex(a, b)) / bits).cast("int")))


def histogram_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller elements, within 0 and 1; 0 if sizes differ or one is missing."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two vectors of doubles."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def clean_basename(path: Column) -> Column:
    """Last path segment in lower case without its extension and without copy marks."""
    name = F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))
    bare = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.trim(F.regexp_replace(bare, r"(\s*-\s*copy|\s*\(\d+\))+", ""))


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or ''."""
    return F.lower(F.regexp_extract(F.trim(path), r"[^/\\.](\.[^./\\]*)$", 1))


def photo_sequence(filename: Column) -> Column:
    """The first run of four digits or more as a number; null without one."""
    return F.nullif(F.regexp_extract(filename, "([0-9]{4,})", 1), F.lit("")).try_cast("bigint")


def parse_video_fingerprint(text: Column) -> Column:
    """``VID_DUR_<seconds>_<hash>`` as (duration, hash); nulls if it isn't one."""
    form = r"^VID_DUR_([0-9.]+)_(.*)$"
    return F.struct(F.nullif(F.regexp_extract(text, form, 1), F.lit("")).try_cast("double").alias("duration"), F.nullif(F.regexp_extract(text, form, 2), F.lit("")).alias("hash"))


def video_fingerprint(duration: Column, digest: Column) -> Column:
    return F.concat(F.lit("VID_DUR_"), F.round(duration).cast("long").cast("string"), F.lit("_"), digest)


def portrait_pair(name_a: Column, at_a: Column, name_b: Column, at_b: Column) -> Column:
    """Whether two files are a portrait and its original: one sequence number, digit for digit, and ``IMG_E`` beside ``IMG_``, a portrait mark or at most 10 seconds between them."""
    a, b = F.upper(name_a), F.upper(name_b)
    digits = lambda x: F.regexp_extract(F.regexp_replace(x, r"\.[^/.]+$", ""), "[0-9]{4,}", 0)
    same = (digits(a) != "") & (digits(a) == digits(b))
    edited = a.startswith("IMG_E") & b.startswith("IMG_") | b.startswith("IMG_E") & a.startswith("IMG_")
    marked = F.contains(a, F.lit("PORTRAIT")) | F.contains(b, F.lit("PORTRAIT"))
    close = F.coalesce(F.abs(F.unix_micros(at_a) - F.unix_micros(at_b)) <= 10_000_000, F.lit(False))
    return F.coalesce(same & (edited | marked | close), F.lit(False))


def normalize_digits(text: Column) -> Column:
    """Letters that are read for digits become them."""
    return F.translate(text, "OoIl|SBZ", "00111582")


def is_copy_name(path: Column) -> Column:
    return F.lower(path).rlike(r"-\s*copy|\([0-9]+\)")


def sanitize_folder(name: Column) -> Column:
    """Reserved characters become '-'; what is then empty becomes General."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(name, r'[<>:"/\\|?*]', "-")), F.lit("")), F.lit("General"))


def format_size(size: Column) -> Column:
    """Bytes in binary units with one decimal; '0 B' for none."""
    unit = F.least(F.floor(F.log(size.cast("double")) / F.log(F.lit(1024.0)) + 1e-12), F.lit(4)).cast("int")
    value = F.round(size / F.pow(F.lit(1024.0), unit), 1)
    return F.when(F.coalesce(size, F.lit(0)) <= 0, "0 B").otherwise(F.concat(F.format_string("%.1f", value), F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), unit + 1)))


def format_date(ts: Column, now: Column) -> Column:
    """Today, Yesterday or the date in words, as of ``now``."""
    days = F.datediff(now, ts)
    return F.when(days == 0, "Today").when(days == 1, "Yesterday").otherwise(F.date_format(ts, "MMMM d, yyyy"))


def quality_score(width: Column, height: Column, size: Column, blur: Column, mime: Column, path: Column) -> Column:
    """0 to 100: pixels up to 30, sharpness up to 25 (15 unmeasured), format 10 to 20, size up to 15, a name without copy marks 5, known dimensions 5."""
    none = lambda x: F.coalesce(x, F.lit(0))
    kind = F.lower(F.coalesce(mime, F.lit("")))
    raw = F.contains(kind, F.lit("raw")) | F.lower(F.coalesce(path, F.lit(""))).rlike(r"\.(cr2|nef|arw|dng)$")
    form = F.when(raw, 20).when(kind.rlike("png|tiff"), 18).when(kind.rlike("heic|heif"), 16).when(kind.rlike("jpe?g"), 14).otherwise(10)
    sharp = F.when(blur >= 0, F.least(F.lit(25.0), blur / 300.0 * 25)).otherwise(15.0)
    pixels = F.least(F.lit(30.0), none(width).cast("double") * none(height) / 1e6 * 2.5)
    bulk = F.least(F.lit(15.0), none(size) / (1024.0 * 1024.0) * 1.5)
    named = F.when(F.coalesce(is_copy_name(path), F.lit(False)), 0).otherwise(5)
    total = pixels + sharp + form + bulk + named + F.when((none(width) > 0) & (none(height) > 0), 5).otherwise(0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))


def has_document_filename(name: Column) -> Column:
    return F.lower(name).rlike(r"\.pdf$|" + "|".join(DOCUMENT_NAMES))


def gps_label(lat: Column, lon: Column) -> Column:
    """Like ``GPS (27.18°N, 78.04°E)``."""
    part = lambda x, plus, minus: F.concat(F.format_string("%.2f", F.abs(x)), F.when(x >= 0, plus).otherwise(minus))
    return F.concat(F.lit("GPS ("), part(lat, "°N", "°S"), F.lit(", "), part(lon, "°E", "°W"), F.lit(")"))


def jittered(id_: Column, x: Column) -> Column:
    """An inferred coordinate moved by a small amount that depends on the id."""
    return x + (id_ % 97 - 48) / 80000.0


def dms_to_decimal(dms: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds as decimal degrees, negative for S and W; null unless there are three."""
    sign = F.when(F.upper(ref).isin("S", "W"), -1.0).otherwise(1.0)
    return F.when(F.size(dms) == 3, sign * (F.get(dms, F.lit(0)) + F.get(dms, F.lit(1)) / 60.0 + F.get(dms, F.lit(2)) / 3600.0))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres on a sphere of 6371 km."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    s, t = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = s * s + F.cos(p1) * F.cos(p2) * t * t
    return F.lit(6371000.0) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def fuzzy_words(low: Column) -> Column:
    """The words of a lower-case text that have three letters or more."""
    return F.filter(F.split(low, r"""[\s,.:;!?'"()\[\]{}/\-_]+"""), lambda w: F.length(w) >= 3)


def fuzzy_includes(low: Column, words: Column, keyword: Column, most: int = 1) -> Column:
    """Whether a lower-case keyword is in a lower-case text (with its ``fuzzy_words``), up to reading errors.

    Under three characters it must stand as a word, else anywhere. From five characters on a word, or a run of as many words as the keyword has, may differ by
    one edit, from eight on by ``most``, two at most.
    """
    n, parts = F.length(keyword), F.size(F.split(keyword, " "))
    allowed = F.when(n >= 8, min(2, most)).when(n >= 5, 1).otherwise(0)
    near = lambda w: (F.abs(F.length(w) - n) <= allowed) & F.levenshtein(w, keyword, 2).between(F.lit(0), allowed)
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - parts + 1), lambda i: F.array_join(F.slice(words, i, parts), " "))
    run = F.when((parts > 1) & (F.size(words) >= parts), F.exists(runs, near)).otherwise(F.lit(False))
    whole = F.rlike(low, F.concat(F.lit(r"\b\Q"), keyword, F.lit(r"\E\b")))
    return F.when(n < 3, whole).otherwise(F.contains(low, keyword) | ((allowed > 0) & (F.exists(words, near) | run)))
