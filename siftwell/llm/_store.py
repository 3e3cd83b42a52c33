"""Intermediate tables in the shared folder, from the library."""

from siftwell.store import LARGE_ROWS, discard, new_path, release, scratch_root, spread, written

__all__ = ["LARGE_ROWS", "discard", "new_path", "release", "scratch_root", "spread", "written"]
