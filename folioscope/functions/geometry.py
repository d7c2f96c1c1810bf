"""Units, boxes, colours, fonts and rotation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope import config
from folioscope.functions.columns import let


def mm(pt: Column) -> Column:
    """Points to millimetres, two decimals, half even."""
    return F.bround(pt * 25.4 / 72, 2)


def box_mm(box: Column) -> Column:
    return F.transform(box, mm)


def snap_size(size: Column, step: float = 0.5) -> Column:
    return F.bround(size / step) * step


def snap(x: Column) -> Column:
    return F.bround(x)


def hex_channel(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value.cast("int"))), 2, "0")


def packed_hex(color: Column) -> Column:
    """A packed RGB integer as #rrggbb."""
    c = color.cast("int")
    return F.concat(F.lit("#"), *[hex_channel(F.shiftright(c, s).bitwiseAND(F.lit(255))) for s in (16, 8, 0)])


def channels_hex(c: Column) -> Column:
    """None, grey, RGB or CMYK (0 to 1) as #rrggbb; whatever else is black."""
    one = lambda v: hex_channel(v * 255)
    at = lambda i: F.try_element_at(c, F.lit(i))
    cmyk = F.concat(F.lit("#"), *[one((1 - at(i)) * (1 - at(4))) for i in (1, 2, 3)])
    return F.coalesce(F.when(F.size(c) == 1, F.concat(F.lit("#"), one(at(1)), one(at(1)), one(at(1)))).when(F.size(c) == 3, F.concat(F.lit("#"), one(at(1)), one(at(2)), one(at(3)))).when(F.size(c) == 4, cmyk), F.lit("#000000"))


def channel(color: Column, i: int) -> Column:
    """Red, green or blue of a hex colour, with or without its sign."""
    return F.conv(F.substring(color, 2 * i + 1, 2), 16, 10).cast("int")


def is_annotation_color(color: Column) -> Column:
    """Within the tolerance of a palette colour in every channel; false for what does not start with six hex digits."""

    def near(c: Column) -> Column:
        out = F.lit(False)
        for p in config.ANNOTATION_COLORS:
            rgb = [int(p[i : i + 2], 16) for i in (1, 3, 5)]
            out = out | ((F.abs(c[0] - rgb[0]) <= config.COLOR_TOLERANCE) & (F.abs(c[1] - rgb[1]) <= config.COLOR_TOLERANCE) & (F.abs(c[2] - rgb[2]) <= config.COLOR_TOLERANCE))
        return out

    digits = F.regexp_extract(F.lower(color), "^#*([0-9a-f]{6})", 1)
    return F.coalesce(F.when(digits != "", let(let(digits, lambda d: F.array(*[channel(d, i) for i in range(3)])), near)), F.lit(False))


def is_bold(font: Column, flags: Column) -> Column:
    return (flags.bitwiseAND(F.lit(1 << 18)) != 0) | F.lower(font).rlike("|".join(config.BOLD_WORDS))


def is_italic(font: Column, flags: Column) -> Column:
    return (flags.bitwiseAND(F.lit(1 << 6)) != 0) | F.lower(font).rlike("|".join(config.ITALIC_WORDS))


def base_font(font: Column) -> Column:
    """A font's family: what follows the last plus sign, without the words for weight, slant and maker."""
    out = F.substring_index(font, "+", -1)
    for suffix in config.FONT_SUFFIXES:
        out = F.replace(out, F.lit(suffix), F.lit(""))
    return F.trim(out)


def rotation(dx: Column, dy: Column) -> Column:
    """A writing direction as the nearest right angle in degrees, 0 to 270."""
    d = F.bround(F.degrees(F.atan2(dy, dx)))
    return F.pmod(F.bround(F.when(d < 0, d + 360).otherwise(d) / 90) * 90, F.lit(360)).cast("int")


def rotation_name(degrees: Column) -> Column:
    return F.when(degrees == 90, "90_CW").when(degrees == 270, "90_CCW").otherwise(degrees.cast("string"))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))
