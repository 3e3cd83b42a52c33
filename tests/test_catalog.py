"""Catalog queries over whole tables, against brute force, and their expressions in the scan modes."""

import random
import struct
import zlib
from datetime import datetime

from siftwell.functions import bits
from siftwell.modes import ScanConfig, scan
from siftwell.plans import catalog


def test_rotations_of_all_images(spark, tmp_path):
    rng = random.Random(3)
    px = {i: [rng.random() for _ in range(64)] for i in range(90)}
    px[89] = [px[2][i] for i in bits.orientations(8)["rot90"]]  # a turned copy, far from it by its id
    spark.createDataFrame(list(px.items()), "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.a, r.b): r.distance for r in catalog.QUERIES["image_rotation_min"](spark, str(tmp_path)).collect()}
    grey = {i: [min(255, int((x + 1) * 128)) for x in p] for i, p in px.items()}
    hashes = lambda p: [sum((p[i] >= sum(p) // 64) << (63 - k) for k, i in enumerate(o)) for o in bits.orientations(8).values()]
    hs = {i: hashes(p) for i, p in grey.items()}
    least = {(a, b): min((x ^ y).bit_count() for x in hs[a] for y in hs[b]) for a in px for b in px if a < b}
    assert got == {k: d for k, d in least.items() if d <= 20} and got[2, 89] == 0


def test_raw_pairs_of_all_parts(spark, tmp_path):
    rows = [(i, f"red  Rose{i % 2}") for i in range(40)]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted((r.raw_id, r.jpeg_id) for r in catalog.QUERIES["raw_jpeg_pairs"](spark, str(tmp_path)).collect())
    assert got == sorted((a, b) for a in range(0, 40, 3) for b in range(1, 40, 3) if a % 2 == b % 2)


def test_components_of_all_orders(spark, tmp_path):
    rows = [(i, i // 2) for i in range(60)]  # two orders for each customer
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.node: r.comp for r in catalog.QUERIES["connected_components"](spark, str(tmp_path)).collect()}
    assert got == {c: -2 * c - 2 for c in range(30)} | {-i - 1: -2 * (i // 2) - 2 for i in range(60)}


def test_tags_of_all_media_pairs(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1), i * 7 % 11, f"t{i % 2}", i % 5 / 4, "p") for i in range(395, 425)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.a, r.b): r.basis for r in catalog.QUERIES["audio_metadata_reason"](spark, str(tmp_path)).collect()}
    tags = {i: {"title": kind, "artist": user % 5, "album": None if i % 3 == 0 else user % 2} for i, _, user, kind, _, _ in rows}
    basis = lambda a, b: ", ".join(t for t in tags[a] if tags[a][t] is not None and tags[a][t] == tags[b][t]) or None
    assert got == {(x[0], y[0]): basis(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[3] == y[3] and abs(x[4] - y[4]) <= 0.5}


def test_audio_reasons_and_errors(spark, tmp_path, monkeypatch):
    probe, mpeg = tmp_path / "probe", tmp_path / "mpeg"
    probe.write_text("#!/bin/sh\n[ $1 = -version ] && exit 0\ncase $7 in *bad*) exit 3;; esac\nprintf 'duration=5\\nTAG:title=Song\\nTAG:artist=%s\\nTAG:album=A\\n' $7\n")
    mpeg.write_text("#!/bin/sh\n[ $1 = -version ] && exit 0\ncat $4\n")
    for name, tool in (("SIFTWELL_FFPROBE", probe), ("SIFTWELL_FFMPEG", mpeg)):
        tool.chmod(0o755)
        monkeypatch.setenv(name, str(tool))
        monkeypatch.setitem(spark.sparkContext.environment, name, str(tool))
    (tmp_path / "in").mkdir()
    for n in ("x.mp3", "y.mp3", "bad.mp3"):
        (tmp_path / "in" / n).write_bytes(b"sound")
    r = scan(spark, ScanConfig(paths=(str(tmp_path / "in"),), mode="similar-audio"))
    assert [i["path"][-5:] for g in r["duplicate_groups"] for i in g["items"]] == ["x.mp3", "y.mp3"]
    assert r["duplicate_groups"][0]["reason"] == "duration delta 0.00s, fingerprint distance 0, metadata title=Song, album=A"
    assert len(r["errors"]) == 1 and r["errors"][0].startswith(f"{tmp_path}/in/bad.mp3: ")


def test_image_reason_tells_the_date(spark, tmp_path):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    pixels = zlib.compress(b"".join(b"\0" + bytes(16 * (r + c) for c in range(8)) for r in range(8)))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 0, 0, 0, 0)) + chunk(b"IDAT", pixels) + chunk(b"IEND", b"")
    date = b"2020:01:02 03:04:05\0"
    exif = b"Exif\0\0II*\0" + struct.pack("<IHHHIII", 8, 1, 0x0132, 2, len(date), 26, 0) + date
    for n in ("a.png", "b.png"):
        (tmp_path / n).write_bytes(png + exif)
    (group,) = scan(spark, ScanConfig(paths=(str(tmp_path),), mode="similar-images"))["duplicate_groups"]
    assert group["reason"] == "perceptual hash distance 0 with matching EXIF date 2020:01:02 03:04:05"
