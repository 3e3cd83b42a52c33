"""Command line: scan, plan, execute, restore, reports."""

from __future__ import annotations

import argparse
import csv
import dataclasses
import io
import json
import sys
from pathlib import Path

from siftwell.actions import plans
from siftwell.modes import CACHE_PATH, CACHED_MODES, MODES, ScanConfig, scan
from siftwell.operators import report as reports
from siftwell.sources.stores import HashCache, ReportStore

PRESETS = {
    "default": {},
    "network-conservative": {"cache": True, "cache_tolerance": 0},
    "network-tolerant": {"cache": True, "cache_tolerance": 2},
    "nas-conservative": {"cache": True, "cache_tolerance": 2, "byte_verify": True},
}


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("siftwell").getOrCreate()


def config(args) -> ScanConfig:
    """Preset fills what neither profile nor flags set; the profile wins over flags except for paths and the cache."""
    profile = json.loads(Path(args.profile).read_text()) if args.profile else {}
    known = {f.name for f in dataclasses.fields(ScanConfig)}
    flags = {k: v for k, v in vars(args).items() if k in known and v is not None}
    preset = PRESETS[args.preset or profile.get("preset") or "default"]
    merged = preset | flags | {k: v for k, v in profile.items() if k in known}
    for k in ("paths", "protected", "ignore_patterns"):
        merged[k] = tuple(flags.get(k) or profile.get(k) or ())
    for k in ("cache", "cache_path"):
        merged |= {k: flags[k]} if k in flags else {}
    return ScanConfig(**merged)


def checked(args, c: ScanConfig) -> str | None:
    """What is wrong with the options of a scan."""
    asked = [x for x in (args.cache, args.cache_path, args.clear_cache or None, args.rebuild_cache or None) if x is not None]
    if args.clear_cache and args.rebuild_cache:
        return "--clear-cache and --rebuild-cache exclude each other"
    if asked and c.mode not in CACHED_MODES:
        return f"cache options go with the modes {', '.join(CACHED_MODES)} only"
    if c.image_size < 4:
        return "--image-size is 4 at least"
    if not 0 <= c.media_threshold <= 256:
        return "--media-threshold lies in 0..256"
    if not c.paths:
        return "a scan needs a path"
    return None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftwell")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("paths", nargs="*")
    s.add_argument("--protected", action="append", default=[])
    s.add_argument("--ignore-patterns", action="append", default=[])
    s.add_argument("--mode", choices=MODES)
    s.add_argument("--algorithm", choices=("blake3", "xxh3_128", "sha256"))
    for name in ("min-size", "prefix-bytes", "name-threshold", "folder-threshold", "image-size", "image-threshold", "media-threshold", "cache-tolerance"):
        s.add_argument(f"--{name}", type=int)
    s.add_argument("--duration-tolerance", type=float)
    for name in ("byte-verify", "include-archives", "rotations", "ignore-hidden", "cache"):
        s.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=None)
    s.add_argument("--cache-path")
    s.add_argument("--clear-cache", action="store_true")
    s.add_argument("--rebuild-cache", action="store_true")
    s.add_argument("--profile")
    s.add_argument("--preset", choices=PRESETS)
    s.add_argument("--output", choices=("human", "json", "csv"), default="human")
    s.add_argument("--report-store")
    s.add_argument("--name", default="scan")
    q = sub.add_parser("plan")
    q.add_argument("report")
    q.add_argument("--rule", choices=plans.RULES, default="keep-suggested")
    q.add_argument("--kind", choices=plans.KINDS, default="quarantine_move")
    q.add_argument("--save")
    v = sub.add_parser("validate")
    v.add_argument("plan")
    e = sub.add_parser("execute")
    e.add_argument("plan")
    e.add_argument("quarantine", nargs="?", default=".quarantine")
    t = sub.add_parser("restore")
    t.add_argument("manifest")
    r = sub.add_parser("reports")
    r.add_argument("store")
    r.add_argument("--filter", default="")
    r.add_argument("--show", type=int)
    for x, forms in ((q, 2), (v, 2), (e, 2), (t, 2), (r, 3)):
        x.add_argument("--output", choices=("human", "json", "csv")[:forms], default="human" if x is r else "json")
    return p


STORED = ["id", "created_at_unix", "name", "mode", "risk", "scanned_files", "group_count"]


def listed(rows: list[dict], form: str) -> str:
    """Stored reports as a list for people, as JSON or as CSV."""
    if form == "json":
        return json.dumps(rows, indent=2) + "\n"
    if form == "csv":
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n")
        w.writerows([STORED, *[[r[c] for c in STORED] for r in rows]])
        return out.getvalue()
    each = [f"  #{r['id']} | {r['name']} | mode={r['mode']} | risk={r['risk']} | files={r['scanned_files']} | groups={r['group_count']}" for r in rows]
    return "\n".join([f"Stored reports: {len(rows)}", *each]) + "\n"


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    forms = {"human": reports.as_text, "json": reports.as_json, "csv": reports.as_csv}
    if args.command == "scan":
        c = config(args)
        if error := checked(args, c):
            print(error, file=sys.stderr)
            return 2
        if args.clear_cache or args.rebuild_cache:
            HashCache(spark or session(), c.cache_path or CACHE_PATH).clear()
            if args.clear_cache:
                print(f"Cleared cache at {c.cache_path or CACHE_PATH}")
                return 0
            c = dataclasses.replace(c, cache=True)
        out = scan(spark or session(), c)
        if args.report_store:
            ReportStore(spark or session(), args.report_store).store(args.name, out)
        print(forms[args.output](out), end="")
    elif args.command == "plan":
        plan = plans.build_plan(json.loads(Path(args.report).read_text()), args.rule, args.kind)
        if args.save:
            plans.save_plan(plan, args.save)
        print(plans.plan_text(plan) if args.output == "human" else json.dumps(plan, indent=2))
    elif args.command == "validate":
        plan = plans.load_plan(args.plan)
        print(plans.plan_text(plan) if args.output == "human" else json.dumps(plan["validation"], indent=2))
        return 1 if plan["validation"]["errors"] else 0
    elif args.command in ("execute", "restore"):
        done = plans.execute(plans.load_plan(args.plan), args.quarantine) if args.command == "execute" else plans.restore(args.manifest)
        print(plans.manifest_text(done) if args.output == "human" else json.dumps(done, indent=2))
    elif args.show is not None:
        print(forms[args.output](ReportStore(spark or session(), args.store).load(args.show)), end="")
    else:
        rows = [r.asDict() for r in ReportStore(spark or session(), args.store).list(args.filter).collect()]
        print(listed(rows, args.output), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
