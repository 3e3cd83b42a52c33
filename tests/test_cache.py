"""Scans with a hash cache, staged reading, sessions and the command line's checks."""

import json
import os
import random
import struct
import time
import zlib

import pytest

from siftwell import cli
from siftwell.functions import hashing
from siftwell.modes import Canceled, ScanConfig, grey_levels, scan, triangle
from siftwell.operators import report as reports
from siftwell.session import Session, review
from siftwell.sources import fswalk, media

random.seed(8)


@pytest.fixture
def tree(tmp_path):
    big = bytes(random.getrandbits(8) for _ in range(5000))
    files = {"a.bin": big, "b.bin": big, "c.bin": big[:-1] + b"x", "d.bin": b"y" + big[1:], "e.txt": b"short", "f.txt": b"short", "g.txt": b"other"}
    (tmp_path / "in").mkdir()
    for n, d in files.items():
        (tmp_path / "in" / n).write_bytes(d)
    return tmp_path


def names(r):
    return sorted(sorted(os.path.basename(i["path"]) for i in g["items"]) for g in r["duplicate_groups"])


def test_second_scan_hashes_nothing(spark, tree, monkeypatch):
    c = ScanConfig(paths=(str(tree / "in"),), prefix_bytes=1000, cache=True, cache_path=str(tree / "cache"), byte_verify=True)
    one = scan(spark, c)
    # seven prefixes; the three long ones that share theirs and the two short ones are hashed whole
    assert names(one) == [["a.bin", "b.bin"], ["e.txt", "f.txt"]] and (one["cache_hits"], one["cache_misses"]) == (0, 12)
    monkeypatch.setattr(fswalk, "read_digests", lambda f, *a: f.selectExpr("*", "'none' AS hash", "CAST(NULL AS STRING) AS read_error").filter("raise_error(path) IS NOT NULL"))
    two = scan(spark, c)
    assert names(two) == names(one) and (two["cache_hits"], two["cache_misses"]) == (12, 0)
    plain = scan(spark, ScanConfig(paths=(str(tree / "cache"),), mode="empty-files"))
    assert (plain["cache_hits"], plain["cache_misses"]) == (0, 0)


def test_a_changed_file_is_hashed_again(spark, tree):
    c = ScanConfig(paths=(str(tree / "in"),), algorithm="xxh3_128", cache=True, cache_path=str(tree / "cache"))
    scan(spark, c)
    (tree / "in" / "g.txt").write_bytes(b"short")
    os.utime(tree / "in" / "g.txt", (time.time() + 60,) * 2)
    r = scan(spark, c)
    assert names(r) == [["a.bin", "b.bin"], ["e.txt", "f.txt", "g.txt"]] and r["cache_misses"] == 2
    os.rename(tree / "in" / "g.txt", tree / "in" / "moved.txt")  # known by its identity
    assert scan(spark, c)["cache_misses"] == 0


def test_unreadable_files_are_errors_and_collisions_are_told_apart(spark, tree):
    files = spark.createDataFrame([(str(tree / "in" / n), 5, "h") for n in ("e.txt", "f.txt", "g.txt", "none")], "path string, size long, hash string")
    got = {os.path.basename(r.path): (os.path.basename(r.bytes_of), r.read_error is None) for r in fswalk.split_by_bytes(files, ["size", "hash"]).collect()}
    assert got == {"e.txt": ("e.txt", True), "f.txt": ("e.txt", True), "g.txt": ("g.txt", True), "none": (got["none"][0], False)}
    (row,) = fswalk.read_digests(files.filter("path LIKE '%none'").drop("hash"), "sha256").collect()
    assert row.hash is None and "none" in row.read_error


def test_streamed_digests(tmp_path):
    data = os.urandom((1 << 20) + 12345)
    (tmp_path / "x").write_bytes(data)
    assert hashing.file_digest(str(tmp_path / "x"), "blake3") == hashing.blake3_many([data])[0]
    assert hashing.file_digest(str(tmp_path / "x"), "blake3", 3000) == hashing.blake3_many([b"", data[:3000]])[1]
    assert hashing.file_digest(str(tmp_path / "x"), "xxh3_128") == hashing.xxh3_hex(data)


def test_presets_and_checks(spark, tree, capsys):
    at, cache = str(tree / "in"), str(tree / "cache")
    parse = lambda *a: cli.config(cli.parser().parse_args(["scan", at, *a]))
    assert parse("--preset", "nas-conservative") == ScanConfig(paths=(at,), cache=True, cache_tolerance=2, byte_verify=True)
    assert not parse("--preset", "network-tolerant", "--no-cache").cache and parse("--preset", "network-conservative").cache_tolerance == 0
    for wrong in (["--clear-cache", "--rebuild-cache"], ["--cache", "--mode", "similar-names"], ["--image-size", "3"], ["--media-threshold", "257"]):
        assert cli.main(["scan", at, *wrong], spark) == 2
    assert cli.main(["scan", at, "--cache", "--cache-path", cache, "--output", "json", "--report-store", str(tree / "store"), "--name", "first"], spark) == 0
    first = json.loads(capsys.readouterr().out)
    assert list(first) == ["mode", "scanned_files", "candidate_size_groups", "cache_hits", "cache_misses", "duplicate_groups", "errors", "risk"] and first["cache_misses"] > 0
    assert cli.main(["scan", at, "--rebuild-cache", "--cache-path", cache, "--output", "csv"], spark) == 0
    head, *rows = capsys.readouterr().out.splitlines()
    assert head == "mode,group,suggested_keep,protected,size,algorithm,hash,reason,path" and len(rows) == 4 and rows[0].startswith("exact,1,true,false,5000,blake3,")
    assert cli.main(["scan", at, "--clear-cache", "--cache-path", cache], spark) == 0 and not os.path.exists(cache)
    capsys.readouterr()
    assert cli.main(["reports", str(tree / "store")], spark) == 0
    assert capsys.readouterr().out.splitlines() == ["Stored reports: 1", "  #1 | first | mode=exact | risk=low | files=7 | groups=2"]
    assert cli.main(["reports", str(tree / "store"), "--output", "csv"], spark) == 0
    assert capsys.readouterr().out.splitlines()[0] == "id,created_at_unix,name,mode,risk,scanned_files,group_count"
    assert cli.main(["reports", str(tree / "store"), "--show", "1"], spark) == 0
    text = capsys.readouterr().out
    assert text.startswith("Mode: exact\nMatch risk: low\nScanned files: 7\n") and "Group 1 | size=5000 | blake3 | same size + same full hash\n  [KEEP] " in text


def test_session(spark, tree):
    s = Session(spark, ScanConfig(paths=(str(tree / "in"),), algorithm="sha256"))
    with pytest.raises(ValueError, match="run a scan"):
        s.make_plan()
    s.start()
    with pytest.raises(RuntimeError):
        s.start()
    assert s.poll(120) and s.status == "2 groups from 7 scanned files" and review(s.report)["groups"][0]["index"] == 1
    s.keep(0, 1)
    assert [i["suggested_keep"] for i in s.report["duplicate_groups"][0]["items"]] == [False, True]
    assert s.make_plan()["items"][0]["path"].endswith("a.bin") and s.remove({1}) == 1 and s.plan is None
    s.export_report(str(tree / "r.json"))
    s.save(str(tree / "s.json"))
    again = Session.load(spark, str(tree / "s.json"))
    assert again.report == s.report == again.load_report(str(tree / "r.json")) and again.config == s.config
    s.start()
    s.cancel()
    assert s.poll(120) and (s.status == str(Canceled("scan canceled")) or s.report is not None)


def test_images_of_other_sizes(spark, tmp_path):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    for n, f in (("a", lambda r, c: 8 * (r + c)), ("b", lambda r, c: 8 * (r + c) + (r == c)), ("z", lambda r, c: 255 - 8 * (r + c))):
        px = zlib.compress(b"".join(b"\0" + bytes(f(r, c) for c in range(16)) for r in range(16)))
        (tmp_path / f"{n}.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 16, 16, 8, 0, 0, 0, 0)) + chunk(b"IDAT", px) + chunk(b"IEND", b""))
    for size in (4, 11):
        c = ScanConfig(paths=(str(tmp_path),), mode="similar-images", image_size=size, image_threshold=8, cache=True, cache_path=str(tmp_path / ".cache"))
        r = scan(spark, c)
        assert names(r) == [["a.png", "b.png"]] and r["cache_misses"] == 3
        assert scan(spark, c)["cache_hits"] == 3
    assert triangle(8, 8).tolist() == [[float(i == j) for j in range(8)] for i in range(8)]
    assert grey_levels(1, 2, 3, bytes([255, 0, 0, 0, 0, 255]), 1) == [36]  # of 18 for blue and 54 for red


def test_tags_and_dates_as_they_are_written():
    assert media.parse_probe("DURATION=9\nduration=x\ntag:title=no\nTAG:title= yes \n") == {"duration": 0.0, "title": "yes", "artist": None, "album": None}
    loop = b"Exif\0\0II*\0" + struct.pack("<IHHHII", 8, 1, 0x8769, 4, 1, 8)
    assert media.exif_date(loop) is None
    inline = b"Exif\0\0II*\0" + struct.pack("<IHHHI4s", 8, 1, 0x0132, 2, 4, b"now\0")
    assert media.exif_date(inline) == "now"


def test_every_folder_matches_at_zero(spark, tmp_path):
    for n in ("x", "y", "z"):
        (tmp_path / n).mkdir()
        (tmp_path / n / f"{n}.txt").write_bytes(n.encode() * 3)
    (group,) = scan(spark, ScanConfig(paths=(str(tmp_path),), mode="duplicate-folders", folder_threshold=0))["duplicate_groups"]
    assert len(group["items"]) == 3 and group["hash"] == "0"
    assert reports.as_csv(scan(spark, ScanConfig(paths=(str(tmp_path),), mode="empty-folders"))).splitlines() == [",".join(reports.CSV_COLUMNS)]
