"""Where a picture of a subtitle goes on a frame: numbers only, no pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _long(x: Column) -> Column:
    return F.rint(x).cast("long")


def placed_overlay(frame: tuple[Column, Column], video: tuple[Column, Column], canvas: tuple[Column, Column], box: tuple[Column, Column, Column, Column]) -> Column:
    """struct (x, y, width, height) of the visible box (left, top, right, bottom) of a canvas on a frame.

    The canvas is centred on the video, and both are scaled as the video was to the frame; a side is a pixel
    at least. Null where nothing is visible (no box).
    """
    (fw, fh), (vw, vh), (cw, ch), (left, top, right, bottom) = frame, video, canvas, box
    sx, sy = fw / vw, fh / vh
    at = F.struct(
        _long(((vw - cw) / 2 + left) * sx).alias("x"), _long(((vh - ch) / 2 + top) * sy).alias("y"),
        F.greatest(F.lit(1), _long((right - left) * sx)).alias("width"), F.greatest(F.lit(1), _long((bottom - top) * sy)).alias("height"),
    )
    return F.when(left.isNotNull() & top.isNotNull() & right.isNotNull() & bottom.isNotNull(), at)


def cropped(width: Column, height: Column, aspect: Column) -> Column:
    """struct (width, left) of a frame cut to an aspect, centred, if it is wider by more than a pixel; left is what x loses."""
    new = _long(height * aspect)
    wide = aspect.isNotNull() & (aspect > 0) & (width > height * aspect + 1)
    return F.struct(F.when(wide, new).otherwise(width.cast("long")).alias("width"), F.when(wide, F.floor((width - new) / 2)).otherwise(F.lit(0)).cast("long").alias("left"))


def uploaded(frame: tuple[Column, Column], overlay: tuple[Column, Column, Column, Column], upload_width: int) -> Column:
    """struct (x, y, width, height) of an overlay (x, y, width, height) on a frame that is scaled up to `upload_width`
    if it is narrower (0: never), kept inside the frame. Nulls where there is no overlay."""
    (fw, fh), (x, y, w, h) = frame, overlay
    scale = F.when((F.lit(upload_width) > 0) & (fw < upload_width), F.lit(float(upload_width)) / fw).otherwise(F.lit(1.0))
    size = [_long(v * scale) for v in (fw, fh, w, h)]
    inside = lambda v, frame_, own: F.when(v.isNotNull(), F.least(F.greatest(_long(v * scale), F.lit(0)), F.greatest(frame_ - own, F.lit(0))))
    return F.struct(inside(x, size[0], size[2]).alias("x"), inside(y, size[1], size[3]).alias("y"), size[2].alias("width"), size[3].alias("height"))
