"""Location anchors and their propagation over sessions, days and camera sequences. Each stage only fills what the one before left open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.places import place_from_text, reverse_geocoded
from shutterlake.operators.catalogue import sessions
from shutterlake.session import cut

REACH = 35


def anchors(photos: DataFrame) -> DataFrame:
    """``photos(id, filename, created_at, gps_lat, gps_lon, extracted_text)`` with city, landmark, location_name, confidence, is_anchor and lat, lon."""
    placed = reverse_geocoded(photos)
    placed = placed.withColumn("_said", F.when(F.col("location_name").isNull(), place_from_text(F.col("extracted_text"))))
    said = F.when(F.col("_said").isNotNull(), F.concat_ws(" • ", F.col("_said.city"), F.col("_said.landmark")))
    out = placed.withColumns({"location_name": F.coalesce("location_name", said), "city": F.coalesce("city", F.col("_said.city")), "landmark": F.coalesce("landmark", F.col("_said.landmark")), "confidence": F.coalesce("confidence", F.col("_said.confidence"))})
    return out.withColumns({"is_anchor": F.col("location_name").isNotNull(), "lat": F.col("gps_lat"), "lon": F.col("gps_lon")}).drop("_said")


def session_propagated(df: DataFrame) -> DataFrame:
    """Rows without a place take the most frequent anchor place of their session (first seen on ties), at the mean of its anchors' coordinates, with confidence 80. A column ``extracted_text`` ends here."""
    df = cut(df.drop("extracted_text"))  # read several times below, and no text is looked at any more
    timed = sessions(df.filter("created_at is not null"), "created_at").withColumn("day", F.to_date("created_at"))
    order = F.struct("created_at", "id")
    own = timed.filter("is_anchor")
    by_place = own.groupBy("day", "session", "location_name").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.min_by("city", order).alias("city"), F.min_by("landmark", order).alias("landmark"))
    top = by_place.groupBy("day", "session").agg(F.min_by(F.struct("location_name", "city", "landmark"), F.struct(-F.col("n"), F.col("first"))).alias("top"))
    means = own.filter("lat is not null and lon is not null").groupBy("day", "session").agg(F.avg("lat").alias("mean_lat"), F.avg("lon").alias("mean_lon"))
    filled = timed.join(top.join(means, ["day", "session"], "left"), ["day", "session"], "left")
    open_ = F.col("location_name").isNull() & F.col("top").isNotNull()
    take = lambda new, old: F.when(open_, new).otherwise(F.col(old)).alias(old)
    new = {"location_name": F.col("top.location_name"), "city": F.col("top.city"), "landmark": F.col("top.landmark"), "confidence": F.lit(80), "lat": F.col("mean_lat"), "lon": F.col("mean_lon")}
    done = filled.select(*[c for c in df.columns if c not in new], *[take(v, k) for k, v in new.items()])
    return done.unionByName(df.filter("created_at is null"))


def day_propagated(df: DataFrame) -> DataFrame:
    """On days of which all anchors are in one city, rows without a place take it, at the mean of the day's coordinates so far, with confidence 75."""
    df, day = cut(df), F.to_date("created_at")
    cities = df.filter("is_anchor and city is not null and created_at is not null").groupBy(day.alias("day")).agg(F.min("city").alias("day_city"), F.max("city").alias("other")).filter("day_city = other").drop("other")
    means = df.filter("lat is not null and lon is not null and created_at is not null").groupBy(day.alias("day")).agg(F.avg("lat").alias("mean_lat"), F.avg("lon").alias("mean_lon"))
    filled = df.withColumn("day", day).join(cities.join(means, "day", "left"), "day", "left")
    open_ = F.col("location_name").isNull() & F.col("day_city").isNotNull()
    new = {"location_name": F.col("day_city"), "city": F.col("day_city"), "confidence": F.lit(75), "lat": F.col("mean_lat"), "lon": F.col("mean_lon")}
    return filled.select(*[c for c in df.columns if c not in new], *[F.when(open_, v).otherwise(F.col(k)).alias(k) for k, v in new.items()])


def sequence_propagated(df: DataFrame, reach: int = REACH) -> DataFrame:
    """Rows ``IMG_<n>`` without a place take that of the nearest anchor at most ``reach`` numbers away, the earliest on ties, with confidence 70.

    Numbers meet by buckets of reach + 1, each with its two neighbours; one anchor stands for each number, so a bucket never holds more than reach + 1 of them.
    """
    width = reach + 1
    number = F.nullif(F.regexp_extract("filename", r"(?i)IMG_([0-9]+)\.", 1), F.lit("")).try_cast("bigint")
    df = cut(df)
    numbered = df.withColumn("num", number)
    own = F.struct("location_name", "city", "landmark", "lat", "lon")
    marks = numbered.filter("is_anchor and num is not null").groupBy("num").agg(F.min_by(own, F.struct("created_at", "id")).alias("near"), F.min(F.struct("created_at", "id")).alias("first"))
    marks = marks.withColumnRenamed("num", "mark").withColumn("bucket", F.explode(F.array(*[F.floor(F.col("mark") / width) + k for k in (-1, 0, 1)])))
    lost = numbered.filter("location_name is null and num is not null").select("id", "num", F.floor(F.col("num") / width).alias("bucket"))
    gap = F.abs(F.col("num") - F.col("mark"))
    found = lost.join(marks, "bucket").filter(gap <= reach).groupBy("id").agg(F.min_by("near", F.struct(gap, "first")).alias("near"))
    joined = df.join(found, "id", "left")
    hit = F.col("near").isNotNull()
    new = {"location_name": F.col("near.location_name"), "city": F.col("near.city"), "landmark": F.col("near.landmark"), "confidence": F.lit(70), "lat": F.col("near.lat"), "lon": F.col("near.lon")}
    return joined.select(*[c for c in df.columns if c not in new], *[F.when(hit, v).otherwise(F.col(k)).alias(k) for k, v in new.items()])


def propagated(photos: DataFrame) -> DataFrame:
    """All stages; rows that end without a place are left out. ``is_inferred``: the place is not the row's own."""
    out = sequence_propagated(day_propagated(session_propagated(anchors(photos))))
    return out.filter("location_name is not null and city is not null").withColumn("is_inferred", ~F.col("is_anchor"))


def matched_trips(df: DataFrame, trips: DataFrame) -> DataFrame:
    """``df(id, day)`` with the first of ``trips(trip_id, first_day, last_day)`` that holds the day. Trips meet days by month, so that the join has an equi-key."""
    months = trips.withColumn("month", F.explode(F.sequence(F.trunc("first_day", "month"), F.trunc("last_day", "month"), F.expr("interval 1 month"))))
    hits = df.withColumn("month", F.trunc("day", "month")).join(months, "month").filter("day between first_day and last_day")
    return hits.groupBy("id").agg(F.min("trip_id").alias("trip_id"))
