"""Column functions for boxes [ymin, xmin, ymax, xmax] on a scale of 0 to 1000, and for picture lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import object_name

SCALE, LEAST_SPAN, LEAST_PIXELS = 1000, 8, 4
MEDIA = "array<struct<object:string,bbox:array<double>,page:int>>"


def is_real(box: Column) -> Column:
    """Four numbers, not all zero; null is not."""
    return F.coalesce((F.size(box) == 4) & F.exists(box, lambda x: x != 0), F.lit(False))


def box_from_json(text: Column) -> Column:
    """The real box that a JSON list spells, else null."""
    box = F.from_json(text, "array<double>")
    return F.when(is_real(box), box)


def clean_box(raw: Column) -> Column:
    """Rounded (half to even), clamped and ordered; null for a wrong length, a null or a side under `LEAST_SPAN`."""
    at = [F.least(F.greatest(F.bround(F.get(raw, F.lit(i)), 0).cast("int"), F.lit(0)), F.lit(SCALE)) for i in range(4)]
    box = F.array(F.least(at[0], at[2]), F.least(at[1], at[3]), F.greatest(at[0], at[2]), F.greatest(at[1], at[3]))
    whole = (F.size(raw) == 4) & ~F.exists(raw, lambda x: x.isNull())
    wide = (F.abs(at[2] - at[0]) >= LEAST_SPAN) & (F.abs(at[3] - at[1]) >= LEAST_SPAN)
    return F.when(whole & wide, box)


def union_box(boxes: Column) -> Column:
    """The box around several, those that are no boxes left out; null if none is one."""
    good = F.filter(F.transform(boxes, clean_box), lambda b: b.isNotNull())
    side = lambda i, f: f(F.transform(good, lambda b: b[i]))
    return F.when(F.size(good) > 0, F.array(side(0, F.array_min), side(1, F.array_min), side(2, F.array_max), side(3, F.array_max)))


def to_pixels(box: Column, width: Column, height: Column) -> Column:
    """struct<x0, y0, x1, y1> on a page of this size; null for no box, no page or under four pixels."""
    clean = clean_box(box)
    edge = lambda i, side: F.least(F.greatest(F.bround(clean[i] / F.lit(float(SCALE)) * side, 0).cast("int"), F.lit(0)), side)
    out = F.struct(edge(1, width).alias("x0"), edge(0, height).alias("y0"), edge(3, width).alias("x1"), edge(2, height).alias("y1"))
    enough = (out["x1"] - out["x0"] >= LEAST_PIXELS) & (out["y1"] - out["y0"] >= LEAST_PIXELS)
    return F.when((width > 0) & (height > 0) & clean.isNotNull() & enough, out)


def to_scale(rect: Column, width: Column, height: Column) -> Column:
    """A box from pixel edges (x0, y0, x1, y1)."""
    unit = lambda i, side: F.bround(F.get(rect, F.lit(i)) / side * F.lit(float(SCALE)), 0)
    return F.when((F.size(rect) == 4) & (width > 0) & (height > 0), clean_box(F.array(unit(1, height), unit(0, width), unit(3, height), unit(2, width))))


def strict_box_fault(box: Column) -> Column:
    """Why a box is refused where nothing is repaired: length, range or order; null if it is good."""
    at = [F.get(box, F.lit(i)) for i in range(4)]
    outside = F.exists(box, lambda x: x.isNull() | (x < 0) | (x > SCALE))
    return F.when(box.isNull() | (F.size(box) != 4), "length").when(outside, "range").when((at[2] <= at[0]) | (at[3] <= at[1]), "order")


def has_figure(areas: Column, low: float = 0.005, high: float = 0.35, full: float = 0.9) -> Column:
    """Whether some picture takes a figure's share of a page that no picture fills."""
    return F.exists(areas, lambda a: (a >= low) & (a < high)) & ~F.exists(areas, lambda a: a >= full)


def crop_key(source: Column, kind: str, number: Column, index: Column) -> Column:
    """The object name of a cut picture, by source and row alone."""
    folder = F.when(source.rlike("^[0-9a-f]{40}-[0-9]+$"), F.regexp_replace(source, "-[0-9]+$", "")).otherwise(source)
    safe = F.coalesce(F.nullif(F.regexp_replace(folder, r"[^A-Za-z0-9_-]", ""), F.lit("")), F.lit("unknown"))
    return F.concat(F.lit("crops/"), safe, F.lit(f"/{kind}"), F.coalesce(number, F.lit(0)).cast("string"), F.lit("-"), F.coalesce(index, F.lit(0)).cast("string"), F.lit(".jpg"))


def media_of(url: Column, box: Column) -> Column:
    """The picture list of one picture: empty without an object."""
    name = object_name(url)
    entry = F.struct(name.alias("object"), F.when(is_real(box), box).cast("array<double>").alias("bbox"), F.lit(1).alias("page"))
    return F.when(name.isNotNull(), F.array(entry)).otherwise(F.expr(f"cast(array() as {MEDIA})"))


def set_box(media: Column, index: Column | int, box: Column) -> Column:
    """The list with the box of one entry replaced; an index outside leaves it as it is."""
    at = F.lit(index) if isinstance(index, int) else index
    return F.transform(media, lambda m, i: F.when(i == at, m.withField("bbox", box)).otherwise(m))


def clear_zero_boxes(media: Column) -> Column:
    """The list with boxes of four zeros set to null, in order."""
    zero = lambda m: (F.size(m["bbox"]) == 4) & F.forall(m["bbox"], lambda x: x == 0)
    return F.transform(media, lambda m: F.when(zero(m), m.withField("bbox", F.lit(None).cast("array<double>"))).otherwise(m))


def holds_zero_box(media: Column) -> Column:
    return F.coalesce(F.exists(media, lambda m: (F.size(m["bbox"]) == 4) & F.forall(m["bbox"], lambda x: x == 0)), F.lit(False))
