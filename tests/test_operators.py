import datetime as dt
import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.functions import places
from shutterlake.functions import scalars as K
from shutterlake.operators import catalogue, duplicates, locations, organize, people, updates
from shutterlake.operators.components import connected_components
from shutterlake.plans.views import Catalog
from shutterlake.sources import media
from shutterlake.streaming import catalogue as streaming

SF = "/root/testdata/sf0.001"


def test_components_do_not_depend_on_edge_order(spark):
    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(60)] + [(100 + int(a), 100 + int(b)) for a, b in rng.integers(0, 80, (50, 2))]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = {x: root(x) for x in parent}
    for order in (edges, [(b, a) for a, b in reversed(edges)] + edges + [(None, 3)]):
        assert {r.node: r.component for r in connected_components(spark.createDataFrame(order, "src long, dst long")).collect()} == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_sessions_split_after_the_gap_not_at_it(spark):
    t = dt.datetime(2024, 1, 1, 1)
    rows = [(1, t), (2, t + dt.timedelta(hours=3.5)), (3, t + dt.timedelta(hours=7, seconds=1)), (4, dt.datetime(2024, 1, 1, 23, 59)), (5, dt.datetime(2024, 1, 2, 0, 1))]
    out = {r.id: r.session for r in catalogue.sessions(spark.createDataFrame(rows, "id long, ts timestamp"), "ts").collect()}
    assert out == {1: 1, 2: 1, 3: 2, 4: 3, 5: 1}


def photo(i, **k):
    return {"id": i, "file_path": f"/a/p{i}.jpg", "filename": f"p{i}.jpg", "file_size": 5000 + 3000 * i, "created_at": dt.datetime(2024, 1, 1) + dt.timedelta(days=i), "width": 400, "height": 300, "mime_type": "image/jpeg", "sha256": f"s{i}", "partial_sha256": f"q{i}", "dhash": "", "phash": "", "video_duration": None} | k


SCHEMA = "id long, file_path string, filename string, file_size long, created_at timestamp, width int, height int, mime_type string, sha256 string, partial_sha256 string, dhash string, phash string, video_duration double"


def flipped(n):
    return f"{(1 << 255) ^ ((1 << n) - 1):064x}"


@pytest.mark.parametrize(("bits", "want"), [(8, 95), (9, 90), (16, 90), (17, None), (24, None)])
def test_image_ladder_at_its_thresholds(spark, bits, want):
    fp = spark.createDataFrame([photo(1, dhash=flipped(0)), photo(2, dhash=flipped(bits))], SCHEMA)
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert [r.confidence for r in duplicates.scored_pairs(pairs, fp).collect()] == ([want] if want else [])


@pytest.mark.parametrize(("bits", "p", "want"), [(12, 4, 95), (20, 6, 90), (24, 10, 85), (24, 11, None)])
def test_both_hashes_together(spark, bits, p, want):
    fp = spark.createDataFrame([photo(1, dhash=flipped(0), phash=f"{1 << 63:016x}"), photo(2, dhash=flipped(bits), phash=f"{(1 << 63) ^ ((1 << p) - 1):016x}")], SCHEMA)
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert [r.confidence for r in duplicates.scored_pairs(pairs, fp).collect()] == ([want] if want else [])


def test_buckets_at_and_over_their_cap(spark):
    def pairs(n, caps):
        rows = [photo(i, video_duration=50.0) for i in range(n)]
        return duplicates.candidate_pairs(spark.createDataFrame(rows, SCHEMA), caps).count()

    assert pairs(30, duplicates.CAPS) == 435 and pairs(31, duplicates.CAPS) == 0 and pairs(31, None) == 465


def test_no_nested_loops_between_photos(spark):
    c = Catalog(spark, SF)
    for df in (catalogue.folder_counts(c.photos, c.folders), duplicates.candidate_pairs(spark.createDataFrame([photo(1)], SCHEMA))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Cartesian" not in plan and "Join Cross" not in plan


def test_sync_then_apply_is_idempotent(spark):
    c = Catalog(spark, SF)
    change = catalogue.sync_diff(c.disk, c.photos)
    after = c.photos.select("file_path").join(change.filter("change = 'removed'").select(F.col("path").alias("file_path")), "file_path", "left_anti").unionByName(change.filter("change = 'added'").select(F.col("path").alias("file_path")))
    assert change.count() > 0 and catalogue.sync_diff(c.disk, after).count() == 0


def test_photo_beside_the_taj_mahal_names_its_neighbour(spark):
    rows = [(101, "a.jpg", dt.datetime(2026, 4, 10, 10), "", 27.1751, 78.0421), (102, "b.jpg", dt.datetime(2026, 4, 10, 10, 45), "", None, None)]
    out = {r.id: r for r in locations.propagated(spark.createDataFrame(rows, "id long, filename string, created_at timestamp, extracted_text string, gps_lat double, gps_lon double")).collect()}
    assert len(out) == 2 and "Agra" in out[102].location_name and out[102].is_inferred and out[101].confidence == 95 and out[102].confidence == 80


def test_camera_numbers_reach_35_frames(spark):
    t = dt.datetime(2026, 4, 10)
    rows = [(1, "IMG_0100.JPG", t, "", 27.1751, 78.0421), (2, "IMG_0135.JPG", t + dt.timedelta(days=9), "", None, None), (3, "IMG_0136.JPG", t + dt.timedelta(days=20), "", None, None), (4, "IMG_0099.jpg", None, "", None, None)]
    out = {r.id: r.confidence for r in locations.propagated(spark.createDataFrame(rows, "id long, filename string, created_at timestamp, extracted_text string, gps_lat double, gps_lon double")).collect()}
    assert out == {1: 95, 2: 70, 4: 70}


def test_far_points_get_their_coordinates(spark):
    df = spark.createDataFrame([(1, -45.0, -120.5), (2, None, None)], "id long, gps_lat double, gps_lon double")
    out = {r.id: (r.city, r.confidence) for r in places.reverse_geocoded(df).collect()}
    assert out == {1: ("GPS (45.00°S, 120.50°W)", 60), 2: (None, None)}


def test_scalar_edges(spark):
    df = spark.createDataFrame([("ff" * 32, "fe" * 32, ""), (None, "aa", "zz")], "a string, b string, c string")
    rows = df.select(K.hamming_hex(F.col("a"), F.col("b")), K.hamming_hex(F.col("a"), F.col("c")), K.match_percent(F.col("a"), F.col("b")), K.sanitize_folder(F.col("c"))).collect()
    assert tuple(rows[0]) == (32, 999, 88, "General") and tuple(rows[1]) == (999, 999, 95, "zz")
    words = spark.createDataFrame([("the invoise of passport office", )], "t string").withColumn("w", K.fuzzy_words(F.col("t")))
    found = [K.fuzzy_includes(F.col("t"), F.col("w"), F.lit(k), n) for k, n in (("invoice", 1), ("invoice", 0), ("pan", 1), ("pasport ofice", 1), ("pasport ofice", 2), ("of", 1), ("ff", 1), ("aadhaar", 1))]
    assert tuple(words.select(*found).first()) == (True, True, False, False, True, True, False, False)


def test_free_names_skip_taken_numbers(spark):
    plan = spark.createDataFrame([(1, "d", "a.jpg"), (2, "d", "A.JPG"), (3, "d", "a.jpg"), (4, "d", "b.jpg")], "id long, folder string, name string")
    existing = spark.createDataFrame([("d", "a.jpg"), ("d", "a (2).jpg"), ("e", "b.jpg")], "folder string, name string")
    assert {r.id: r.new_name for r in organize.free_names(plan, existing).collect()} == {1: "a (1).jpg", 2: "A (3).JPG", 3: "a (4).jpg", 4: "b.jpg"}


def test_faces_cluster_and_people_merge(spark):
    rng = np.random.default_rng(0)
    rows = [(10 * p + k, p, [float(x) for x in np.eye(8)[p] + rng.normal(0, 0.02, 8)]) for p in range(4) for k in range(5)]
    faces = spark.createDataFrame(rows, "id long, person_id long, descriptor array<double>")
    assert {r.id: r.cluster_id for r in people.clustered_faces(faces).collect()} == {i: 10 * p for i, p, _ in rows}
    assert {r.id: r.person_id for r in people.assigned_faces(faces.filter("id % 10 = 4").drop("person_id"), faces.filter("id % 10 < 4")).collect()} == {10 * p + 4: p for p in range(4)}
    split = faces.withColumn("person_id", F.when(F.col("id") > 31, 7).otherwise(F.col("person_id")))
    assert [(r.a, r.b, r.confidence) for r in people.merge_suggestions(split).collect()] == [(3, 7, 99)]


def test_far_blocks_of_vectors_never_meet(spark, monkeypatch):
    from shutterlake.operators import vectors

    monkeypatch.setattr(vectors, "ROWS", 50)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 3, (30, 16))
    of = np.concatenate([rng.integers(0, 30, 800), np.full(400, 7)])  # one cluster holds a third
    v = centres[of] + rng.normal(0, 0.05, (1200, 16))
    rows = [(i, int(of[i]), [float(x) for x in v[i]]) for i in range(1200)]
    odd = [(5000, 1, None), (5001, 1, [float("nan")] * 16), (5002, 1, [None] * 16)]
    faces = spark.createDataFrame(rows + odd, "id long, person_id long, descriptor array<double>").repartition(4)
    own = vectors.celled(faces, (), vectors.pivots_for(faces))
    blocks = int(own.parts.sum())
    looked = vectors.block_pairs(own, own, 0.48, True).count()
    assert own.sizes.sum() == 1200 and looked < blocks * (blocks + 1) / 2 / 4
    assert vectors.block_pairs(own, own, float("inf"), True).count() == blocks * (blocks + 1) // 2
    gap = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    least = np.arange(1200)
    while True:  # components by brute force
        nxt = np.array([least[gap[i] < 0.48].min() for i in range(1200)])
        if (nxt == least).all():
            break
        least = nxt
    want = dict(enumerate(least.tolist())) | {i: i for i in (5000, 5001, 5002)}
    assert {r.id: r.cluster_id for r in people.clustered_faces(faces).collect()} == want
    near = {i: min(((gap[i, j], j) for j in range(300, 1200)), default=None) for i in range(300)}
    got = people.assigned_faces(faces.filter("id < 300 or id > 1200").drop("person_id"), faces.filter("id >= 300 and id <= 5001"), 0.3)
    assert {r.id: r.person_id for r in got.collect()} == {i: int(of[j]) for i, (d, j) in near.items() if d < 0.3}
    assert people.clustered_faces(faces.filter("id > 4999")).count() == 3 and people.assigned_faces(faces.limit(0), faces).count() == 0 == people.assigned_faces(faces, faces.limit(0)).count()


def png(path, pixels):
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_pixels_of_copies_agree_and_of_others_do_not(spark, tmp_path):
    y, x = np.mgrid[0:96, 0:128]
    wave = np.stack([(127 + 120 * np.sin(x / 9)), 2 * y, (x + y)], axis=2).clip(0, 255).astype(np.uint8)
    png(tmp_path / "a.png", wave)
    png(tmp_path / "b.png", wave)
    png(tmp_path / "c.png", wave[:, ::-1].copy())
    (tmp_path / "d.png").write_bytes(b"no picture")
    out = {r.origin.rsplit("/", 1)[1]: r for r in media.pixel_features(media.pixel_source(spark, str(tmp_path))).collect()}
    assert set(out) == {"a.png", "b.png", "c.png"}
    assert out["a.png"].dhash == out["b.png"].dhash != out["c.png"].dhash and out["c.png"].dhash in out["a.png"].rotations
    assert abs(sum(out["a.png"].color_histogram) - 1) < 1e-9 and out["a.png"].blur_score > 0
    files = spark.read.format("binaryFile").load(str(tmp_path))
    digests = {r.path.rsplit("/", 1)[1]: (r.sha256, r.partial_sha256) for r in media.content_digests(files).collect()}
    assert digests["a.png"] == digests["b.png"] != digests["c.png"] and media.scan_media(spark, str(tmp_path)).count() == 4


def test_manifests_are_listed(spark, tmp_path):
    plan = spark.createDataFrame([(1, 10), (2, 20)], "id long, file_size long")
    run = media.write_manifest(plan, str(tmp_path))
    row = media.manifests(spark, str(tmp_path)).first()
    assert (row.run_id, row.n, row.n_bytes) == (run, 2, 30)


def drained(spark, df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_streams_equal_batches(spark):
    c = Catalog(spark, SF)
    events = c.events.withColumn("ts", F.col("ts").cast("timestamp"))
    source = spark.readStream.schema(c.events.schema).option("pathGlobFilter", "events.parquet").parquet(SF).withColumn("ts", F.col("ts").cast("timestamp"))
    end = events.agg(F.max("ts")).first()[0]
    got = {(r.user_id, r["first"], r["n"]) for r in drained(spark, streaming.stream_sessions(source, "user_id"), "sessions")}
    want = {(r.user_id, r.w.start, r["n"]) for r in events.groupBy("user_id", F.session_window("ts", "210 minutes").alias("w")).agg(F.count("*").alias("n")).collect() if r.w.end <= end - dt.timedelta(hours=1)}
    assert got == want
    days = {(r.day, r["n"]) for r in drained(spark, streaming.stream_timeline(source), "days")}
    assert days and days <= {tuple(r) for r in events.groupBy(F.to_date("ts")).count().collect()}
    assert len(drained(spark, streaming.stream_exact_dedup(source, "event_id").select("event_id"), "dedup")) == events.select("event_id").distinct().count()
    # closed at its end, a stream gives all
    whole = {(r.user_id, r.w.start, r["n"]) for r in events.groupBy("user_id", F.session_window("ts", "210 minutes").alias("w")).agg(F.count("*").alias("n")).collect()}
    assert {(r.user_id, r["first"], r["n"]) for r in streaming.drained(events, lambda e: streaming.stream_sessions(e, "user_id")).collect()} == whole > got
    assert streaming.drained(events.limit(0), lambda e: streaming.stream_sessions(e, "user_id")).count() == 0


def test_stream_into_catalog_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in" / ".hidden").mkdir(parents=True)
    for name in ("a.jpg", "b.MOV", "c.zip", ".hidden/d.jpg"):
        (tmp_path / "in" / name).write_bytes(b"x")
    for names in (("a.jpg", "b.MOV"), ("a.jpg", "b.MOV", "e.heic")):
        if "e.heic" in names:
            (tmp_path / "in" / "e.heic").write_bytes(b"y")
        writer = streaming.stream_into_catalog(streaming.stream_catalog(spark, str(tmp_path / "in")), str(tmp_path / "table"))
        writer.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        assert sorted(r.filename for r in streaming.catalogue_rows(spark, str(tmp_path / "table")).collect()) == sorted(names)


def test_known_digests(spark):
    small, large = b"abc", bytes(range(256)) * 1024
    row = {r.name: r for r in media.content_digests(spark.createDataFrame([("s", bytearray(small)), ("l", bytearray(large))], "name string, content binary")).collect()}
    assert row["s"].sha256 == row["s"].partial_sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    ends = large[:65536] + f"size_{len(large)}".encode() + large[-65536:]
    assert row["l"].sha256 == hashlib.sha256(large).hexdigest() and row["l"].partial_sha256 == hashlib.sha256(ends).hexdigest() != row["l"].sha256


def test_updates_check_names_and_undo(spark):
    tags = spark.createDataFrame([(1, "Beach")], "id long, name string")
    got = updates.got_or_created(tags, spark.createDataFrame([("beach",), ("Sea",), ("sea",), ("Art",)], "name string"))
    assert sorted((r.id, r.name) for r in got.collect()) == [(1, "Beach"), (2, "Art"), (3, "Sea")]
    for bad in (" ", None):
        with pytest.raises(Exception, match="a name is empty"):
            updates.got_or_created(tags, spark.createDataFrame([(bad,)], "name string")).collect()
    moves = spark.createDataFrame([("r1", "/a", "/b")], "run_id string, path string, new_path string")
    runs = spark.createDataFrame([("r1", False), ("r2", True)], "run_id string, undone boolean")
    assert updates.undone(runs, moves, "r1").first().path == "/b"
    for run in ("r2", "r3"):
        with pytest.raises(ValueError, match=run):
            updates.undone(runs, moves, run)
    plan = spark.createDataFrame([(1, "d", "x.jpg"), (2, "d", "X.jpg"), (3, "d", "y.jpg")], "id long, folder string, name string")
    there = spark.createDataFrame([("d", "Y.JPG")], "folder string, name string")
    names = lambda how: [r.new_name for r in updates.resolved_names(plan, there, how).orderBy("id").collect()]
    assert names("overwrite") == ["x.jpg", "X.jpg", "y.jpg"] and names("skip") == ["x.jpg", None, None] and names("rename") == ["x.jpg", "X (1).jpg", "y (1).jpg"]


def test_merge_chains_and_circles(spark):
    chain = spark.createDataFrame([(k + 1, k) for k in range(1, 40)], "old long, new long")
    assert {tuple(r) for r in catalogue.merge_ends(chain).collect()} == {(k, 1) for k in range(2, 41)}
    with pytest.raises(ValueError, match="circle"):
        catalogue.merge_ends(spark.createDataFrame([(1, 2), (2, 1)], "old long, new long"))


def test_text_named_places(spark):
    df = spark.createDataFrame([("at the Taj Mahal gate",), ("welcome to Pune",), ("pune",), ("nothing",), (None,)], "t string")
    assert [r.x and (r.x.city, r.x.confidence) for r in df.select(places.place_from_text(F.col("t")).alias("x")).collect()] == [("Agra", 90), ("Pune", 75), None, None, None]


def test_portrait_pairs(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("IMG_1234.JPG", t, "IMG_E1234.JPG", t + dt.timedelta(days=1)), ("a1234.jpg", t, "b1234.jpg", t + dt.timedelta(seconds=10)), ("a1234.jpg", t, "b1234.jpg", t + dt.timedelta(seconds=11)), ("a.jpg", t, "a.jpg", t)]
    df = spark.createDataFrame(rows, "a string, at timestamp, b string, bt timestamp")
    assert [r[0] for r in df.select(K.portrait_pair(F.col("a"), F.col("at"), F.col("b"), F.col("bt"))).collect()] == [True, True, False, False]


def test_stream_pairs_each_batch_with_those_before(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([photo(10 * k + i, sha256=f"s{i}", file_path=f"/a/x{k}{i}y.jpg", filename=f"x{k}{i}y.jpg", created_at=None, partial_sha256="", file_size=0) for i in range(3)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    writer = streaming.stream_fingerprints(source, str(tmp_path / "keys"), str(tmp_path / "pairs"))
    writer.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "pairs")).collect()} == {(i, 10 + i) for i in range(3)}


def test_every_supported_extension_is_media(spark):
    names = ["a.heic", "b.MOV", "c.cr2", "d.tif", "e.gif", "f.jpg", "g.xyz", "none"]
    disk = spark.createDataFrame([(f"/lib/{n}", 10) for n in names], "path string, length long")
    photos = spark.createDataFrame([("\\lib\\a.heic",), ("/lib/b.MOV",), ("/lib/gone.cr2",)], "file_path string")
    change = {(r.path, r.change) for r in catalogue.sync_diff(disk, photos).collect()}
    assert change == {("/lib/c.cr2", "added"), ("/lib/d.tif", "added"), ("/lib/e.gif", "added"), ("/lib/f.jpg", "added"), ("/lib/gone.cr2", "removed")}
    sides = {(r.ext, r.side) for r in organize.source_breakdown(disk).collect()}
    assert sides == {(".heic", "media"), (".mov", "media"), (".cr2", "media"), (".tif", "media"), (".gif", "media"), (".jpg", "media"), (".xyz", "other"), ("", "other")}
    assert all(catalogue.sync_diff(disk.limit(0).union(spark.createDataFrame([(f"/x.{e}", 1)], "path string, length long")), photos.limit(0)).count() == 1 for e in ("braw", "svg", "docx"))


def pictures(spark, rows):
    """Fingerprints of ``(id, dhash, phash, sha, mime, seconds)``."""
    full = [(i, f"/x/{i % 7}/p{i}z.jpg", f"p{i}z.jpg", 1000 + i, None, 400, 300, mime, sha, "", d, p, seconds) for i, d, p, sha, mime, seconds in rows]
    return spark.createDataFrame(full, "id long, file_path string, filename string, file_size long, created_at timestamp, width long, height long, mime_type string, sha256 string, partial_sha256 string, dhash string, phash string, video_duration double")


def test_complete_links_of_one_hash_are_linear(spark):
    from shutterlake.operators import duplicates as dup

    for n in (40, 10_000):
        rows = [(i, "ab" * 32, "12" * 8, f"s{i}", "image/jpeg", None) for i in range(n)]
        fp = pictures(spark, rows)
        links = cut_rows(dup.complete_links(fp))
        assert len(links) == n - 1
        assert {r.group_id for r in dup.complete_groups(fp).collect()} == {0}
    assert dup.grouped(pictures(spark, rows[:40]), dup.links_of(pictures(spark, rows[:40]))).count() == 0  # the capped form keeps silent


def cut_rows(df):
    return {tuple(r) for r in df.collect()}


def mixed_pictures(n=260):
    """Rows of six looks with up to 25 bits changed, blank and missing hashes, films, shared digests and few block hashes."""
    import numpy as np

    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("0123456789abcdef"), 64)) for _ in range(6)]
    rows = []
    for i in range(n):
        film = i % 5 == 0
        bits = int(base[rng.integers(6)], 16)
        for b in rng.choice(256, rng.integers(0, 26), replace=False):
            bits ^= 1 << int(b)
        p = int(rng.integers(0, 3)) * 0x1111 ^ (1 << int(rng.integers(0, 64)))
        rows.append((i, f"{bits:064x}" if i % 17 else ("0" * 64 if i % 2 else ""), f"{p:016x}" if i % 11 else "", f"s{i // 2}" if i % 13 == 0 else "", "video/mp4" if film else "image/jpeg", float(rng.integers(0, 9)) if film else None))
    return rows


def test_complete_groups_are_those_of_all_pairs(spark):
    from shutterlake.operators import duplicates as dup

    fp = pictures(spark, mixed_pictures()).repartition(3)
    every = dup.grouped(fp, dup.scored_pairs(dup.candidate_pairs(fp, caps=None), fp))
    want = {(r.id, r.group_id) for r in every.collect()}
    assert len(want) > 100
    for chunk, few in ((16, 2), (2048, 32), (7, 0)):
        assert {(r.id, r.group_id) for r in dup.grouped(fp, dup.complete_links(fp, chunk, few)).collect()} == want


def groups_of(links):
    from shutterlake.operators.components import connected_components

    return {(r.node, r.component) for r in connected_components(links.toDF("src", "dst")).collect()}


def test_new_links_complete_what_stored_rows_have(spark):
    from shutterlake.operators import duplicates as dup

    fp = pictures(spark, mixed_pictures()).repartition(3)
    want = groups_of(dup.complete_links(fp))
    assert len(want) > 100
    for fresh, chunk, few in (("id % 3 = 1", 2048, 32), ("id % 3 = 1", 7, 0), ("id < 20", 16, 2), ("id >= 0", 11, 0), ("id < 0", 2048, 32)):
        new, stored = fp.filter(fresh), fp.filter(f"not ({fresh})")
        links = dup.new_links(dup.keyed_looks(new), dup.keyed_looks(stored), chunk, few)
        assert groups_of(dup.complete_links(stored).union(links)) == want
        if fresh == "id < 0":
            assert links.isEmpty()


def test_small_buckets_meet_without_being_written(spark, monkeypatch):
    from shutterlake.operators import duplicates as dup

    wrote, written = [], dup.written
    monkeypatch.setattr(dup, "written", lambda df, name: wrote.append((name, df.count())) or written(df, name))
    fp = pictures(spark, mixed_pictures(60))
    assert not dup.complete_links(fp).isEmpty() and sum(n for _, n in wrote) == 0  # rows lie under many keys each: no table has a row for each key
    wrote.clear()
    assert groups_of(dup.complete_links(fp, 3, 0)) == groups_of(dup.complete_links(fp))


def test_new_links_of_a_hot_bucket_follow_the_new_rows(spark):
    from shutterlake.operators import duplicates as dup

    fp = pictures(spark, [(i, f"{1 << 255 | i % 4:064x}", f"{7:016x}", "", "image/jpeg", None) for i in range(6000)])
    links = dup.new_links(dup.keyed_looks(fp.filter("id >= 5900")), dup.keyed_looks(fp.filter("id < 5900")))
    assert 100 <= links.count() <= 120  # 590,000 pairs
    assert {g for _, g in groups_of(dup.complete_links(fp.filter("id < 5900")).union(links))} == {0}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def holds(low, keyword, most):
    import re

    words = [w for w in re.split(r"""[\s,.:;!?'"()\[\]{}/\-_]+""", low) if len(w) >= 3]
    n, parts = len(keyword), len(keyword.split(" "))
    if n < 3:
        return bool(re.search(r"\b" + re.escape(keyword) + r"\b", low))
    allowed = min(2, most) if n >= 8 else 1 if n >= 5 else 0
    runs = words + [" ".join(words[i : i + parts]) for i in range(len(words) - parts + 1)]
    return keyword in low or bool(allowed and any(abs(len(r) - n) <= allowed and edits(r, keyword) <= allowed for r in runs))


def test_many_rules_are_rows_and_match_brute_force(spark):
    import re

    import numpy as np

    from shutterlake.operators import documents

    rng = np.random.default_rng(3)
    pool = [f"{a}{b}{c}" for a in ("bill", "tax", "in", "pay") for b in ("voice", "ment", "order") for c in ("", "s", "ed")] + ["no", "id", "gst", "water bill", "tax order form"]
    pick = lambda n: tuple(str(x) for x in rng.choice(pool, n))
    rules = [documents.Rule(i, f"rule {i}", f"c{i % 9}", pick(2), pick(3), pick(3), pick(i % 3), r"\b[0-9]{4}\b" if i % 4 == 0 else "") for i in range(165)]
    texts = [None, "", "two words"]
    for i in range(60):
        own = [str(x) for x in rng.choice(pool + ["lorem", "ipsum", "1234"], rng.integers(2, 14))]
        k = int(rng.integers(len(own)))
        w = own[k]
        at = int(rng.integers(len(w)))
        own[k] = (w[:at] + w[at + 1 :], w[:at] + "q" + w[at:], w[:at] + "q" + w[at + 1 :], w.upper())[i % 4]
        texts.append((" ", ", ", "\n")[i % 3].join(own))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, keyword string").repartition(3)
    got = {r.id: r._rule and tuple(r._rule) for r in documents.with_best_rule(df, rules, "text").collect()}
    for i, t in enumerate(texts):
        low, best = (t or "").lower(), None
        for r in rules:
            if len((t or "").split()) >= 3 and any(holds(low, k, 1) for k in r.required) and not any(k in low for k in r.negative if len(k) >= 3):
                points = 35 + 30 * bool(r.regex and re.search(r.regex, t)) + 15 * sum(holds(low, k, 1) for k in r.strong) + 5 * sum(holds(low, k, 0) for k in r.weak)
                if best is None or points > best[2]:
                    best = (r.name, r.category, points)
        assert got[i] == best, t

    def size(n):
        return len(documents.with_best_rule(df, rules[:n], "text")._jdf.queryExecution().optimizedPlan().toString())

    assert abs(size(60) - size(165)) < 0.1 * size(60)


def test_vectors_meet_in_tiles_and_once(spark, monkeypatch):
    from shutterlake.operators import people, vectors

    monkeypatch.setattr(vectors, "ROWS", 40)
    monkeypatch.setattr(vectors, "TILE", 300)
    monkeypatch.setattr(people, "_means", None)  # limits that reach every distance need no second pass
    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, (200, 8)).astype(np.float32)
    v[100] = v[3]
    faces = spark.createDataFrame([(i, i % 7, [float(x) for x in v[i]]) for i in range(200)], "id long, person_id long, descriptor array<float>").repartition(3)
    assert max(gap.size for _, gap in vectors.tiles(v, v[:90])) <= 300
    assert {len(r.v) for r in vectors.celled(faces, (), vectors.pivots_for(faces)).rows.collect()} == {32}  # four bytes an entry
    w = v.astype(np.float64)
    gap = np.sqrt(((w[:, None] - w[None]) ** 2).sum(axis=2))
    of = np.arange(200) % 7
    got = {(r.a, r.b): (r.distance, r.effective) for r in people.merge_suggestions(faces, sure=1.0, likely=9.0, best=0.9).collect()}
    want = {}
    for a in range(7):
        for b in range(a + 1, 7):
            part = gap[of == a][:, of == b]
            least = min(1.0, part.min())
            want[a, b] = (least, 0.65 * least + 0.35 * part.mean())
    assert set(got) == set(want) and all(abs(got[k][i] - want[k][i]) < 1e-4 for k in want for i in (0, 1))
    least = np.arange(200)
    while not (nxt := np.array([least[gap[i] < 1.3].min() for i in range(200)])).tolist() == least.tolist():
        least = nxt
    assert [r.cluster_id for r in people.clustered_faces(faces, 1.3).orderBy("id").collect()] == least.tolist()
    near = gap[:50, 50:].argmin(axis=1)
    found = people.assigned_faces(faces.filter("id < 50").drop("person_id"), faces.filter("id >= 50"), 9.0).orderBy("id").collect()
    assert [r.person_id for r in found] == ((near + 50) % 7).tolist()


def test_a_top_folder_meets_parents_not_files(spark):
    from shutterlake.sources.media import assigned_folders

    paths = [f"/a/b/{i}.jpg" for i in range(30)] + ["/a/c/x.jpg", "/a/c/x.jpg", "/z.jpg", "x.jpg", "\\\\d\\y.jpg", None]
    files = spark.createDataFrame([(p, n) for n, p in enumerate(paths)], "path string, n int").repartition(3)
    folders = spark.createDataFrame([(2, "/a"), (1, "/a/b"), (3, "/q")], "id long, folder_path string")
    out = assigned_folders(files, folders)
    got = {r.n: r.source_folder_path for r in out.collect()}
    assert [got[n] for n in range(36)] == ["/a/b"] * 30 + ["/a", "/a", "", "x.jpg", "\\\\d", None] and out.columns == ["path", "n", "source_folder_path"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Generate") :]  # the listing of folders is over distinct parents


def test_a_pair_is_measured_once(spark):
    from shutterlake.operators import duplicates as dup

    fp = pictures(spark, mixed_pictures(40))
    found = dup.links_of(fp)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bit_count") == 5  # four words of one hash, one of the other, however many levels look at them
    pairs = dup.candidate_pairs(fp).union(dup.digest_links(fp)).distinct()
    assert sorted(found.collect()) == sorted(dup.scored_pairs(pairs, fp).collect())


def test_pairs_too_far_apart_never_leave_their_bucket(spark, monkeypatch):
    from shutterlake.operators import duplicates as dup

    kept, cut = [], dup.cut
    monkeypatch.setattr(dup, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    rng = random.Random(4)
    few = pictures(spark, [(i, f"{rng.getrandbits(256):064x}", "12" * 8, "", "image/jpeg", None) for i in range(28)])  # one block hash, 378 pairs
    assert dup.links_of(few).isEmpty() and dup.scored_candidates(few).isEmpty() and [df.count() for df in kept] == [0, 0]

    fp = pictures(spark, mixed_pictures(120)).withColumn("rotations", F.array(F.lower("dhash"), F.reverse("dhash")))
    more = fp.withColumn("color_histogram", F.array(F.lit(0.5), F.lit(0.5))).withColumn("video_keyframes", F.array(F.when(F.length("dhash") == 64, F.col("dhash")).otherwise("0" * 64)))
    for df in (fp, more):
        for turned in (False, True):
            want = sorted(dup.scored_pairs(dup.candidate_pairs(df, None), df, turned).collect())
            assert len(want) > 30 and sorted(dup.scored_candidates(df, None, turned).collect()) == want


def test_merge_suggestions_look_at_near_people_alone(spark):
    import numpy as np

    from shutterlake.operators import people

    rng = np.random.default_rng(8)
    centres = rng.standard_normal((6, 16)) * 0.2
    rows, vectors = [], {}
    for i in range(90):
        p = i % 9
        v = centres[p % 6] + rng.standard_normal(16) * 0.05
        rows.append((i, p, [float(x) for x in v]))
        vectors.setdefault(p, []).append(np.array(rows[-1][2]))
    got = {(r.a, r.b): (r.distance, r.effective) for r in people.merge_suggestions(spark.createDataFrame(rows, "id long, person_id long, descriptor array<double>")).collect()}
    want = {}
    for a in vectors:
        for b in vectors:
            if a < b:
                d = np.array([np.linalg.norm(x - y) for x in vectors[a] for y in vectors[b]])
                least = min(1.0, d.min())
                effective = 0.65 * least + 0.35 * d.mean()
                if least <= 0.44 or effective <= 0.48:
                    want[a, b] = (round(least, 4), round(effective, 4))
    assert set(got) == set(want) and 3 <= len(want) < 36
    assert all(abs(got[k][i] - want[k][i]) < 2e-4 for k in want for i in (0, 1))


def test_free_names_of_one_name(spark):
    from shutterlake.operators.organize import free_names

    plan = spark.createDataFrame([(i, "f", "A.jpg") for i in range(200)] + [(900, "f", "b (2).jpg"), (901, "g", "a.JPG")], "id long, folder string, name string").repartition(3)
    existing = [("f", f"a ({n}).jpg") for n in (1, 2, 5, 7, 8, 150, 3000)] + [("f", "a.jpg"), ("f", "b (2).jpg"), ("f", "A (5).JPG")]
    got = {r.id: r.new_name for r in free_names(plan, spark.createDataFrame(existing, "folder string, name string")).collect()}
    taken = {0, 1, 2, 5, 7, 8, 150, 3000}
    free = iter(n for n in range(5000) if n not in taken)
    assert [got[i] for i in range(200)] == [f"A ({next(free)}).jpg" for _ in range(200)]
    assert got[901] == "a.JPG" and got[900] == "b (2) (1).jpg"


def test_keyset_pages_equal_offsets(spark):
    from pyspark.sql import functions as F

    from shutterlake.operators import catalogue as op

    rows = spark.range(0, 1037, 1, 5).select("id", (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=(F.col("id") % 13).cast("int"))).alias("created_at"))
    want = [r.id for r in rows.orderBy(F.desc("created_at"), F.desc("id")).collect()]
    starts = op.page_starts(rows, 50).cache()
    assert starts.count() == 21
    for page in (0, 3, 20):
        assert [r.id for r in op.keyset_page(rows, starts, page).collect()] == want[50 * page : 50 * page + 50]
    assert op.keyset_page(rows, starts, 21).count() == 0


def test_exact_median(spark):
    from shutterlake.operators.catalogue import exact_median

    for values, want in (([], None), ([None], None), ([3.0], 3.0), ([1.0, 2.0], 1.5), ([5.0, None, 1.0, 9.0], 5.0), ([7.0] * 50 + [1.0] * 49 + [9.0], 7.0), ([1.0] * 5 + [2.0] * 5, 1.5), ([float(i % 101) for i in range(1000)], 49.5)):
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
        assert exact_median(df, "v") == want, values


def test_sketches_add_up(spark):
    from shutterlake.operators import summaries

    df = spark.range(50_000).selectExpr("id % 3 as k", "id % 5 as day", "id", "if(id % 7 = 0, null, id % 20000) as v", "cast(null as double) as none")
    days = summaries.distinct_sketches(df, ["k", "day"], F.col("v"), F.col("k"))
    exact = {r.k: r.n for r in df.filter("v is not null").groupBy("k").agg(F.count_distinct("v").alias("n")).collect()}
    got = {r.k: r.n for r in summaries.distinct_of(days, ["k"]).collect()}
    assert set(got) == set(exact) and all(abs(got[k] - n) < 0.07 * n for k, n in exact.items())
    assert summaries.distinct_of(summaries.distinct_sketches(df, [], F.col("none"))).first().n == 0
    old = summaries.quantile_sketches(df.filter("id < 40000 and k < 2"), ["k"], F.col("id"))
    new = summaries.quantile_sketches(df.filter("id >= 40000 or k = 2"), ["k"], F.col("id"))
    rows = {r.k: r for r in summaries.quantiles_of(summaries.added(old, new, ["k"]), ["k"], [0.1, 0.5]).collect()}
    assert sum(r.n for r in rows.values()) == 50_000
    for r in rows.values():
        assert abs(r.quantiles[0] - 5_000) < 1_000 and abs(r.quantiles[1] - 25_000) < 1_000
    (none,) = summaries.quantiles_of(summaries.quantile_sketches(df.filter("k = 0"), ["k"], F.col("none")), ["k"], [0.5]).collect()
    assert none.n == 0 and none.quantiles is None


def test_groups_are_sorted_by_what_is_asked(spark):
    from shutterlake.operators.updates import sort_groups

    groups = spark.createDataFrame([(1, 10, 90, 2), (2, 30, 75, 2), (3, 10, 99, 5)], "group_id long, recoverable_bytes long, confidence int, n long")
    order = lambda by: [r.group_id for r in sort_groups(groups, by).collect()]
    assert (order("size"), order("confidence"), order("count")) == ([2, 1, 3], [3, 1, 2], [3, 1, 2])


def test_misread_words_equal_the_expressions(spark):
    """The helpers of tasks against ``fuzzy_includes`` on words with random edits, and substrings."""
    from shutterlake.functions import readings
    from shutterlake.operators import documents

    rng, keywords = random.Random(3), list(documents.MISREAD)
    texts = ["", "the republic off india (republik of indja)", "incometax office", "voter ids / uidai", "elect1on comission"]
    for k, _ in keywords * 12:
        w = list(k)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice(["", "z", w[at] + "q"])
        texts.append(f"some {''.join(w)}, words-here {rng.choice(['pass', 'income', 'electio'])}")
    df = documents.read_words(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    for row in df.select("t", *[K.fuzzy_includes(F.col("_low"), F.col("_words"), F.lit(k), n).alias(f"k{i}") for i, (k, n) in enumerate(keywords)], readings.misread_bits(F.col("_low"), keywords).alias("bits")).collect():
        assert [bool(row.bits >> i & 1) for i in range(len(keywords))] == [row[f"k{i}"] for i in range(len(keywords))], row.t
    held = readings.held_words(["tax", "x i", "axi"])
    assert (held("taxi in"), held("tax in x i"), held("")) == ({"tax", "axi"}, {"tax", "x i"}, set())


def test_texts_are_not_read_by_loops_over_words_and_rules(spark):
    """Word lists, rules and places cost one look at each distinct word, not an interpreted loop over all words for each keyword."""
    from shutterlake.plans import catalogue

    for name in ("c3_identity_signatures", "c4_taxonomy", "c5_classify_text", "c6_text_categories"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "levenshtein" not in plan and "_keywords" not in plan, name


def test_pairs_of_a_large_key_meet_in_units(spark):
    rows = [(i, f"IMG_{'E' if i % 7 == 0 else ''}{4000 + i % 3}.jpg", dt.datetime(2024, 1, 1, 0, 0, i % 60)) for i in range(90)] + [(90, "portrait_4001.jpg", None), (91, "x.jpg", None)]
    df = spark.createDataFrame(rows, "id long, name string, at timestamp")
    both = df.alias("a").join(df.alias("b"), F.expr("a.id < b.id")).filter(K.portrait_pair(F.col("a.name"), F.col("a.at"), F.col("b.name"), F.col("b.at")))
    want = {(r[0], r[1]) for r in both.select("a.id", "b.id").collect()}
    for unit in (4, 2048):
        got = [tuple(r) for r in duplicates.portrait_pairs(df, unit).collect()]
        assert len(got) == len(want) and set(got) == want


def test_new_pairs_of_a_large_key_are_given_out_once(spark):
    rows = [(i, f"/p/IMG-20240101-WA{i % 5}.jpg", f"IMG-20240101-WA{i % 5}.jpg", 100 + i % 4, f"s{i % 9}", "p", "", "", dt.datetime(2024, 1, 1, 0, 0, i % 60), None) for i in range(60)]
    fp = spark.createDataFrame(rows, "id long, file_path string, filename string, file_size long, sha256 string, partial_sha256 string, dhash string, phash string, created_at timestamp, video_duration double")
    want = {(min(a, b), max(a, b)) for a in range(0, 60, 3) for b in range(60) if a != b}  # all share a sequence number
    got = [tuple(r) for r in duplicates.new_pairs(fp.filter("id % 3 = 0"), duplicates.blocking_keys(fp.filter("id % 3 > 0")), unit=7).collect()]
    assert len(got) == len(want) and set(got) == want


def test_parts_of_a_hash_lose_no_near_one(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        x = rng.getrandbits(256)
        y = x
        for b in rng.sample(range(256), 24):
            y ^= 1 << b
        rows.append((i, x, y))
    word = lambda v, k: (w := v >> (192 - 64 * k) & (2**64 - 1)) - (1 << 64 if w >> 63 else 0)
    look = "struct<" + ",".join(f"dhash{k}:long" for k in range(4)) + ">"
    sides = [spark.createDataFrame([(r[0], tuple(word(r[s], k) for k in range(4))) for r in rows], f"id long, look {look}").select("id", duplicates._parts().alias(f"p{s}")) for s in (1, 2)]
    both = {r.id: (r.p1, r.p2) for r in sides[0].join(sides[1], "id").collect()}
    ends = [256 * i // 25 for i in range(26)]
    for i, x, y in rows:
        for v, parts in zip((x, y), both[i]):
            assert parts == [v >> (256 - b) & ((1 << (b - a)) - 1) for a, b in zip(ends, ends[1:])]
        assert any(p == q for p, q in zip(*both[i]))


def test_rows_of_a_large_key_are_copied_a_bounded_number_of_times(spark, monkeypatch):
    dealt, written = [], duplicates.written
    monkeypatch.setattr(duplicates, "written", lambda df, name: dealt.append(df) or written(df, name))
    df = spark.range(150).select("id", F.lit("x").alias("key"))
    both = duplicates.joined_in_units(df, df.withColumnRenamed("id", "other"), "key", "id", "other", 2).collect()
    assert len(both) == len({(r.id, r.other) for r in both}) == 150 * 150
    assert [(r._of, r._by) for r in dealt[0].collect()] == [(duplicates.COPIES, duplicates.COPIES)]  # not 75, half the rows
