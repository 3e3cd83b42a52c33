"""A review session: one scan at a time on a thread of its own, its report, plan and manifest, and what is stored of them."""

from __future__ import annotations

import dataclasses
import json
import threading
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

from siftwell.actions import plans
from siftwell.modes import Canceled, CancelToken, ScanConfig, scan
from siftwell.operators import report as reports
from siftwell.sources.stores import ReportStore


def review(report: dict) -> dict:
    """What a reviewer sees: groups numbered from 1, a risk label and a line that sums the report up."""
    groups = report["duplicate_groups"]
    return {
        "mode": report["mode"], "risk_label": report["risk"], "summary_line": f"{len(groups)} groups from {report['scanned_files']} scanned files",
        "scanned_files": report["scanned_files"], "cache_hits": report["cache_hits"], "cache_misses": report["cache_misses"], "group_count": len(groups),
        "groups": [{"index": n, "size": g["size"], "algorithm_or_engine": g["algorithm"], "reason": g["reason"], "items": g["items"]} for n, g in enumerate(groups, 1)],
        "errors": report["errors"],
    }


class Session:
    """State of a review; scans run in a Spark job group, so that canceling one stops its jobs as well."""

    def __init__(self, spark: SparkSession, config: ScanConfig | None = None):
        self.spark, self.config = spark, config or ScanConfig()
        self.report = self.source = self.plan = self.manifest = None
        self.status, self.progress = "Ready", None
        self._thread = self._token = self._group = self._end = None

    def start(self, config: ScanConfig | None = None) -> None:
        if self.running():
            raise RuntimeError("a scan is already running")
        self.config = config or self.config
        self._token, self._group, self._end = CancelToken(), f"siftwell-{uuid.uuid4().hex}", None

        def work() -> None:
            self.spark.sparkContext.setJobGroup(self._group, f"scan {self.config.mode}", interruptOnCancel=True)
            try:
                self._end = scan(self.spark, self.config, self._token, self._told), None
            except Exception as e:  # noqa: BLE001 - told by poll()
                self._end = None, Canceled("scan canceled") if self._token.is_set() else e

        self.status = "Scanning"
        self._thread = threading.Thread(target=work, daemon=True)
        self._thread.start()

    def _told(self, phase: str) -> None:
        self.progress = phase

    def running(self) -> bool:
        return self._thread is not None

    def cancel(self) -> None:
        if self.running():
            self._token.cancel()
            self.spark.sparkContext.cancelJobGroup(self._group)

    def poll(self, wait: float = 0) -> bool:
        """Whether a scan ended since the last call; its report is then the session's."""
        if not self.running():
            return False
        self._thread.join(wait)
        if self._thread.is_alive():
            return False
        self._thread = self.progress = None
        found, error = self._end
        if error is not None:
            self.status = str(error)
            return True
        self.report, self.source, self.plan, self.manifest = found, {"kind": "scan"}, None, None
        self.status = review(found)["summary_line"]
        return True

    def _have_report(self, what: str) -> dict:
        if self.report is None:
            raise ValueError(f"run a scan before {what}")
        return self.report

    def keep(self, group: int, item: int) -> None:
        """Another copy to keep in a group (both counted from 0); plans made before are dropped."""
        report = self._have_report("choosing what to keep")
        if report["mode"] != "exact":
            raise ValueError("what to keep can be chosen for exact scans only")
        if not 0 <= group < len(report["duplicate_groups"]) or not 0 <= item < len(report["duplicate_groups"][group]["items"]):
            raise IndexError("no such group or item")
        for i, x in enumerate(report["duplicate_groups"][group]["items"]):
            x["suggested_keep"] = i == item
        self.plan = self.manifest = None
        self.status = f"Keeper override set for group {group + 1}"

    def remove(self, groups: set[int]) -> int:
        """Take groups (counted from 0) out of the review; how many there were."""
        report = self._have_report("removing groups")
        kept = [g for i, g in enumerate(report["duplicate_groups"]) if i not in groups]
        gone = len(report["duplicate_groups"]) - len(kept)
        report["duplicate_groups"] = kept
        self.plan = self.manifest = None
        return gone

    def make_plan(self, rule: str = "keep-suggested", kind: str = "quarantine_move") -> dict:
        self.plan = plans.build_plan(self._have_report("planning"), rule, kind)
        return self.plan

    def execute(self, quarantine: str) -> dict:
        if self.plan is None:
            raise ValueError("make a plan before it is executed")
        self.manifest = plans.execute(self.plan, quarantine)
        return self.manifest

    def restore(self, manifest: str) -> dict:
        self.manifest = plans.restore(manifest)
        return self.manifest

    def store_report(self, path: str, name: str) -> int:
        return ReportStore(self.spark, path).store(name, self._have_report("storing it"))

    def load_report(self, path: str, ident: int | None = None) -> dict:
        """A stored report by its number, or one exported to a file."""
        self.report = json.loads(Path(path).read_text()) if ident is None else ReportStore(self.spark, path).load(ident)
        self.source = {"kind": "file", "path": path} if ident is None else {"kind": "store", "path": path, "id": ident}
        self.plan = self.manifest = None
        return self.report

    def export_report(self, path: str) -> None:
        Path(path).write_text(reports.as_json(self._have_report("exporting it")))

    def save(self, path: str) -> None:
        state = {"config": dataclasses.asdict(self.config)} | {k: getattr(self, k) for k in ("report", "source", "plan", "manifest", "status")}
        Path(path).write_text(json.dumps(state, indent=2))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Session:
        state = json.loads(Path(path).read_text())
        config = {k: tuple(v) if isinstance(v, list) else v for k, v in state.pop("config").items()}
        out = cls(spark, ScanConfig(**config))
        for k, v in state.items():
            setattr(out, k, v)
        return out
