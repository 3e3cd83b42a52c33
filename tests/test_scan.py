import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from siftwell import cli
from siftwell.actions import plans
from siftwell.functions import hashing, names
from siftwell.modes import CancelToken, Canceled, ScanConfig, scan
from siftwell.operators import report, simjoin
from siftwell.operators.components import components
from siftwell.sources import media
from siftwell.sources.stores import HashCache, ReportStore


def make(root, **files):
    for name, data in files.items():
        p = root / name.replace("__", "/")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return str(root)


def run(spark, root, **options):
    return scan(spark, ScanConfig(paths=(str(root),), **options))


def paths(r):
    return [sorted(os.path.basename(i["path"]) for i in g["items"]) for g in r["duplicate_groups"]]


@pytest.fixture
def three(tmp_path):
    for n, d in (("archive/keep.txt", b"same"), ("current/copy.txt", b"same"), ("current/unique.txt", b"different")):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(d)
    return tmp_path


@pytest.mark.parametrize("algorithm", ["blake3", "sha256"])
def test_exact(spark, three, algorithm):
    r = run(spark, three, algorithm=algorithm, protected=(str(three / "archive"),), byte_verify=True)
    assert paths(r) == [["copy.txt", "keep.txt"]] and r["scanned_files"] == 3 and r["candidate_size_groups"] == 1
    g = r["duplicate_groups"][0]
    assert g["items"][0]["path"].endswith("keep.txt") and g["items"][0]["suggested_keep"] and g["reason"].endswith("byte-by-byte verified")
    assert json.loads(report.as_json(r))["mode"] == "exact" and report.as_csv(r).count("\n") == 3 and "[KEEP]" in report.as_text(r)


def test_hidden_and_missing(spark, tmp_path):
    for n in (".a", ".b", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert run(spark, tmp_path)["scanned_files"] == 1
    assert run(spark, tmp_path, ignore_hidden=False)["scanned_files"] == 3
    with pytest.raises(FileNotFoundError):
        run(spark, tmp_path / "none")
    assert run(spark, tmp_path / "none", mode="empty-folders")["duplicate_groups"] == []


def test_names_and_raw(spark, tmp_path):
    for n in ("Vacation 2024.jpg", "vacation_2024 copy.jpg", "taxes.pdf", "IMG_1001.CR2", "IMG-1001.jpg"):
        (tmp_path / n).write_bytes(n.encode())
    assert ["Vacation 2024.jpg", "vacation_2024 copy.jpg"] in paths(run(spark, tmp_path, mode="similar-names", name_threshold=70))
    r = run(spark, tmp_path, mode="raw-jpeg-pairs")
    assert paths(r) == [["IMG-1001.jpg", "IMG_1001.CR2"]] and r["risk"] == "medium"


def test_folders(spark, tmp_path):
    for n in ("left/photo.jpg", "right/photo.jpg", "left/a.tmp"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"same size")
    assert paths(run(spark, tmp_path, mode="duplicate-folders", ignore_patterns=("*.tmp",))) == [["left", "right"]]
    assert paths(run(spark, tmp_path, mode="duplicate-folders")) == []


def test_reviews(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    for n, d in (("a", b""), ("b", b""), ("big", b"0123456789"), ("photo.txt", b"\x89PNG\r\n\x1a\n"), ("good.png", b"\x89PNG\r\n\x1a\n")):
        (tmp_path / n).write_bytes(d)
    assert paths(run(spark, tmp_path, mode="empty-files")) == [["a", "b"]]
    assert paths(run(spark, tmp_path, mode="empty-folders")) == [["empty"]]
    large = run(spark, tmp_path, mode="large-files", min_size=1)["duplicate_groups"][0]
    assert large["items"][0]["path"].endswith("big") and large["size"] == 10
    assert paths(run(spark, tmp_path, mode="bad-extensions")) == [["photo.txt"]]


def test_archives(spark, tmp_path):
    for n, member in (("left.zip", "a.txt"), ("right.zip", "b.txt")):
        with zipfile.ZipFile(tmp_path / n, "w") as z:
            z.writestr(member, "same content")
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    r = run(spark, tmp_path, mode="duplicate-archive-members")
    assert paths(r) == [["left.zip!a.txt", "right.zip!b.txt"]] and all(i["is_protected"] for i in r["duplicate_groups"][0]["items"])
    assert paths(run(spark, tmp_path, mode="empty-archives")) == [["none.zip"]]


def test_media_gate(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("SIFTWELL_FFMPEG", "no-such-tool")
    r = run(spark, tmp_path, mode="similar-videos")
    assert r["scanned_files"] == 0 and "no-such-tool" in r["errors"][0]
    assert media.parse_probe("duration=123.45\nTAG:title= T \nTAG:artist=\n") == {"duration": 123.45, "title": "T", "artist": None, "album": None}


def test_cancel(spark, three):
    token = CancelToken()
    token.cancel()
    with pytest.raises(Canceled):
        scan(spark, ScanConfig(paths=(str(three),)), token)


@pytest.mark.parametrize("kind", plans.KINDS)
def test_plan_execute_restore(spark, three, tmp_path, kind):
    r = run(spark, three, algorithm="sha256")
    plan = plans.build_plan(r, kind=kind)
    assert plan["summary"]["items_selected"] == 1 and not plan["validation"]["errors"]
    gone = plan["items"][0]["path"]
    done = plans.execute(plan, str(tmp_path / "q"))
    assert done["items"][0]["status"] == "completed" and os.path.lexists(gone) == (kind != "quarantine_move")
    back = plans.restore(f"{done['root']}/manifest.json")
    assert back["items"][0]["status"] == "restored" and open(gone, "rb").read() == b"same" and not os.path.islink(gone)


def test_drift_is_refused(spark, three, tmp_path):
    plan = plans.build_plan(run(spark, three, algorithm="sha256"))
    with open(plan["items"][0]["path"], "wb") as f:
        f.write(b"SAME")
    with pytest.raises(ValueError, match="content changed"):
        plans.execute(plan, str(tmp_path / "q"))


def test_stores(spark, three, tmp_path):
    r = run(spark, three, algorithm="sha256")
    store = ReportStore(spark, str(tmp_path / "reports"))
    assert [store.store("one", r), store.store("two", r)] == [1, 2]
    assert store.load(2) == r and [x.name for x in store.list(" TWO ").collect()] == ["two"]
    cache = HashCache(spark, str(tmp_path / "cache"))
    entry = "path string, device_id string, inode string, size long, modified_unix long, algorithm string, scope string, bytes_hashed long, hash string, created_unix long"
    cache.store(spark.createDataFrame([("/a", "d", "1", 4, 100, "sha256", "full", -1, "old", 1)], entry))
    files = spark.createDataFrame([("/a", "d", "1", 4, 102), ("/b", "d", "1", 4, 100), ("/c", "d", "9", 4, 100), ("/a", "d", "1", 5, 100)], "path string, device_id string, inode string, size long, modified_unix long")
    hit = lambda t: sorted((x.path, x.size, x.hash) for x in cache.lookup(files.filter("size = 4"), "sha256", "full", -1, t).collect())
    assert hit(2) == [("/a", 4, "old"), ("/b", 4, "old"), ("/c", 4, None)] and hit(0)[0][2] is None
    changed = cache.lookup(files.filter("size = 5"), "sha256", "full", -1, 2).collect()
    assert [x.hash for x in changed] == [None]  # a changed size never finds the old hash


def test_command_line(spark, three, capsys):
    assert cli.main(["scan", str(three), "--output", "csv", "--algorithm", "sha256"], spark) == 0
    assert capsys.readouterr().out.splitlines()[0] == ",".join(report.CSV_COLUMNS)
    assert cli.main(["scan"], spark) == 2


def test_name_pairs_against_all_pairs(spark):
    random.seed(1)
    words = ["alpha", "beta", "gama", "gamma", "alfa", "x", "notes", "note"]
    made = sorted({" ".join(random.choices(words, k=random.randint(1, 4)))[: random.randint(1, 20)].strip() for _ in range(80)} | {""})
    norms = spark.createDataFrame([(x,) for x in made], "norm string")
    every = norms.select(F.col("norm").alias("a")).join(norms.select(F.col("norm").alias("b")), F.col("a") < F.col("b")).withColumn("score", names.name_score(F.col("a"), F.col("b")))
    scores = {(r.a, r.b): r.score for r in every.collect()}
    for t in (30, 60, 85, 100):
        got = {(r.a, r.b) for r in simjoin.name_pairs(norms, t).collect()}
        assert got == {k for k, s in scores.items() if s >= t}, t


def test_hamming_pairs_against_all_pairs(spark):
    random.seed(2)
    base = [random.getrandbits(63) for _ in range(5)]
    rows = [(i, random.choice(base) ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 9)) if b < 63)) for i in range(80)]
    hashes = spark.createDataFrame(rows, "id long, h long").select("id", F.array("h").alias("h"))
    got = {(r.a, r.b): r.distance for r in simjoin.hamming_pairs(hashes, "id", "h", 10).collect()}
    want = {(a, b): (x ^ y).bit_count() for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= 10}
    assert got == want


def test_components_and_hashes(spark):
    random.seed(3)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(40)]
    parent = list(range(60))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for e in edges if e[0] != e[1] for v in e}
    assert hashing.blake3_hex(b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"


def test_media_bands_against_all_pairs(spark):
    random.seed(4)
    base = [random.getrandbits(256) for _ in range(4)]
    rows = []
    for i in range(120):
        f = random.choice(base) ^ sum(1 << b for b in random.sample(range(256), random.choice([0, 0, 3, 20, 40])))
        rows.append((i, random.choice([float("nan"), None] + [random.randint(0, 40) / 4] * 8), None if i % 30 == 0 else f"{f:064x}"))
    m = spark.createDataFrame(rows, "id long, duration double, fingerprint string")
    for tolerance, most in ((0.5, 32), (2.0, 0), (0.0, 60)):
        got = {(r.a, r.b): (r.delta, r.distance) for r in simjoin.band_pairs(m, tolerance, most).collect()}
        want = {}
        for a, da, fa in rows:
            for b, db, fb in rows:
                if a < b and None not in (da, db, fa, fb) and abs(da - db) <= tolerance and (d := (int(fa, 16) ^ int(fb, 16)).bit_count()) <= most:
                    want[a, b] = abs(da - db), d
        assert got == want and (want or most == 0)
