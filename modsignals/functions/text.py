"""Text columns: P13, P14, P16."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BODY_CHARS, PREVIEW_CHARS, TITLE_CHARS, WATCH_URL_PREFIX


def body_cut(body: Column, chars: int = BODY_CHARS) -> Column:
    """The stored body is cut by definition; an absent body is the empty string."""
    return F.coalesce(F.substring(body, 1, chars), F.lit(""))


def preview(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    """P16; an absent text previews as an empty one."""
    return F.concat(F.coalesce(F.substring(text, 1, chars), F.lit("")), F.lit("..."))


def title_preview(title: Column) -> Column:
    return preview(title, TITLE_CHARS)


def watch_url(video_id: Column) -> Column:
    """P14."""
    return F.concat(F.lit(WATCH_URL_PREFIX), video_id)
