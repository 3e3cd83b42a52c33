"""Media files by external tools, and EXIF dates; without the tools a scan reports one error and no files."""

from __future__ import annotations

import os
import struct
import subprocess

from siftwell.functions.hashing import blake3_hex

# Seconds until a tool is stopped, and what is sampled.
VERSION_S, PROBE_S, FINGERPRINT_S = 10, 20, 30
VIDEO_ARGS = ("-map", "0:v:0", "-vf", "fps=1,scale=32:32:flags=bilinear,format=gray", "-frames:v", "6", "-f", "rawvideo", "-")
AUDIO_ARGS = ("-map", "0:a:0", "-ac", "1", "-ar", "8000", "-t", "30", "-f", "s16le", "-")
PROBE_KEYS = {"duration": "duration", "TAG:title": "title", "TAG:artist": "artist", "TAG:album": "album"}
DATE_TAGS = (0x9003, 0x9004, 0x0132)


def tools() -> dict[str, str]:
    return {"ffmpeg": os.environ.get("SIFTWELL_FFMPEG", "ffmpeg"), "ffprobe": os.environ.get("SIFTWELL_FFPROBE", "ffprobe")}


def missing_tool() -> str | None:
    for name, command in tools().items():
        try:
            subprocess.run([command, "-version"], capture_output=True, timeout=VERSION_S, check=True)
        except (OSError, subprocess.SubprocessError):
            return f"{name} is not available: {command}"
    return None


def parse_probe(text: str) -> dict:
    """key=value lines; an unreadable duration is 0, blank tags are unknown."""
    out = {"duration": 0.0, "title": None, "artist": None, "album": None}
    for line in text.splitlines():
        key, sep, value = line.partition("=")
        name, value = PROBE_KEYS.get(key.strip()), value.strip()
        if not sep or name is None:
            continue
        if name == "duration":
            try:
                out[name] = float(value)
            except ValueError:
                out[name] = 0.0
        else:
            out[name] = value or None
    return out


def analyze(path: str, video: bool) -> dict:
    t = tools()
    probe = subprocess.run([t["ffprobe"], "-v", "error", "-show_entries", "format=duration:format_tags=title,artist,album", "-of", "default=noprint_wrappers=1:nokey=0", path], capture_output=True, timeout=PROBE_S, check=True)
    raw = subprocess.run([t["ffmpeg"], "-v", "error", "-i", path, *(VIDEO_ARGS if video else AUDIO_ARGS)], capture_output=True, timeout=FINGERPRINT_S, check=True).stdout
    return parse_probe(probe.stdout.decode(errors="replace")) | {"fingerprint": blake3_hex(raw)}


def exif_date(data: bytes) -> str | None:
    """The first date among original, digitized and changed, from the APP1 segment of a JPEG."""
    at = data.find(b"Exif\0\0")
    if at < 0:
        return None
    tiff = data[at + 6 :]
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None:
        return None
    found: dict[int, str] = {}

    seen: set[int] = set()

    def directory(offset: int) -> None:
        if offset in seen:  # a directory that points at itself or back
            return
        seen.add(offset)
        try:
            (n,) = struct.unpack_from(order + "H", tiff, offset)
            for i in range(n):
                at = offset + 2 + 12 * i
                tag, kind, count, value = struct.unpack_from(order + "HHII", tiff, at)
                if tag == 0x8769:
                    directory(value)
                elif tag in DATE_TAGS and kind == 2:
                    begin = at + 8 if count <= 4 else value  # up to four bytes stand in the entry itself
                    text = tiff[begin : begin + count].split(b"\0")[0].decode("utf-8", "replace").strip()
                    if text:
                        found.setdefault(tag, text)
        except struct.error:
            return

    try:
        directory(struct.unpack_from(order + "I", tiff, 4)[0])
    except struct.error:
        return None
    return next((found[t] for t in DATE_TAGS if t in found), None)
