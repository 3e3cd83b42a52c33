"""Tags that two media files share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AUDIO_TAGS = ("title", "artist", "album")


def shared_tags(left: dict[str, Column], right: dict[str, Column], values: bool = False) -> Column:
    """The names of the tags that are known and equal, joined by `, `, with their values if asked; null without any."""
    said = lambda t: F.concat(F.lit(f"{t}="), left[t]) if values else F.lit(t)
    return F.nullif(F.concat_ws(", ", *[F.when(left[t] == right[t], said(t)) for t in AUDIO_TAGS]), F.lit(""))
