"""EAN-13 symbols drawn as bars: grouping into symbols, decoding by sampling modules, check digit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope import config
from folioscope.functions.geometry import mm
from folioscope.operators import clusters


def check_digit(twelve: Column) -> Column:
    total = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda a, i: a + F.substring(twelve, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    return F.pmod(10 - total % 10, F.lit(10))


def digit(code: Column, table: list[str]) -> Column:
    """The 0-based place of a code in a table, null if it has none."""
    at = F.array_position(F.array(*map(F.lit, table)), code)
    return F.when(at > 0, at - 1)


def bars_of(drawings: DataFrame, page: list[str]) -> DataFrame:
    """The rectangles of filled drawings: page and box. Strokes are borders and fold lines."""
    return drawings.filter(F.col("type").isin("f", "fs")).select(*page, F.explode("items").alias("i")).filter("i.op = 're'").select(*page, "i.x0", "i.y0", "i.x1", "i.y1")


def symbols(items: DataFrame, page: list[str]) -> DataFrame:
    """Filled rectangles (x0, y0, x1, y1) of bar shape as symbols: page, band, run, bars sorted by x0, box, bar_count, bbox_mm, height_mm.

    Bars of one band share a top edge with the band's anchor; a gap of BAR_GAP upper-median widths ends a symbol."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    bars = items.filter((h > w) & (w > 0) & (h >= config.BAR_MIN_PT))
    tops = bars.groupBy(*page).agg(clusters.anchors(F.collect_list("y0"), config.BAR_TOP_PT).alias("tops"))
    bars = bars.join(tops, page).withColumn("band", F.size(F.filter("tops", lambda t: t <= F.col("y0")))).drop("tops")
    keys = [*page, "band"]
    widths = bars.groupBy(*keys).agg(F.array_sort(F.collect_list(w)).alias("ws"))
    mid = F.element_at("ws", F.floor(F.size("ws") / 2).cast("int") + 1)
    bars = bars.join(widths.select(*keys, mid.alias("width")), keys)
    before = F.lag("x1").over(Window.partitionBy(*keys).orderBy("x0"))
    bars = clusters.islands(bars.withColumn("before", before), keys, ["x0"], F.col("x0") - F.col("before") > config.BAR_GAP * F.col("width"))
    out = bars.groupBy(*keys, F.col("island").alias("run")).agg(F.array_sort(F.collect_list(F.struct("x0", "x1"))).alias("bars"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    out = out.withColumns({"x1": F.element_at("bars", -1)["x1"], "bar_count": F.size("bars")}).filter(F.col("bar_count") >= config.EAN_MIN_BARS)
    return out.withColumns({"bbox_mm": F.array(*[mm(F.col(e)) for e in ("x0", "y0", "x1", "y1")]), "height_mm": mm(F.col("y1") - F.col("y0"))})


def modules(bars: Column, x0: Column, x1: Column) -> Column:
    """The 95 modules as a text of ones and zeros, by sampling each one's centre."""
    step = (x1 - x0) / config.EAN_MODULES

    def at(i: Column) -> Column:
        x = x0 + (i + 0.5) * step
        return F.when(F.exists(bars, lambda b: (b["x0"] - 1e-6 <= x) & (x <= b["x1"] + 1e-6)), "1").otherwise("0")

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(config.EAN_MODULES - 1)), at), "")


def decoded(symbols_: DataFrame) -> DataFrame:
    """symbols with value, reason (why there is none), check_digit_valid, check_digit_expected, module_width_mm and magnification.

    The first thing that cannot be read is the reason: no width, the guards, a left or a right digit, the parity."""
    out = symbols_.withColumn("modules", modules(F.col("bars"), F.col("x0"), F.col("x1")))
    left, right = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.substring("modules", 4 + 7 * i, F.lit(7))), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.substring("modules", 51 + 7 * i, F.lit(7)))
    out = out.withColumns({"left": left, "right": right})
    known = F.create_map(*[F.lit(v) for t, mark in ((config.EAN_L, "0"), (config.EAN_G, "1")) for d, c in enumerate(t) for v in (c, mark + str(d))])
    rights = F.create_map(*[F.lit(v) for d, c in enumerate(config.EAN_R) for v in (c, str(d))])
    out = out.withColumns({"l": F.transform("left", lambda c: F.try_element_at(known, c)), "r": F.transform("right", lambda c: F.try_element_at(rights, c))})
    out = out.withColumn("parity", F.array_join(F.transform("l", lambda x: F.substring(x, 1, 1)), ""))
    first = digit(F.col("parity"), config.EAN_FIRST)
    unread = lambda codes, digits: F.get(F.filter(F.transform(codes, lambda c, i: F.when(F.get(digits, i).isNull(), c)), F.isnotnull), 0)
    guards = F.col("modules").rlike("^101.{42}01010.{42}101$")
    out = out.withColumns({"bad_left": unread(F.col("left"), F.col("l")), "bad_right": unread(F.col("right"), F.col("r")), "first": first})
    reason = (
        F.when(F.col("x1") <= F.col("x0"), "zero-width bar block").when(~guards, "guard patterns do not match EAN-13")
        .when(F.col("bad_left").isNotNull(), F.concat(F.lit("unrecognised left chunk "), "bad_left")).when(F.col("bad_right").isNotNull(), F.concat(F.lit("unrecognised right chunk "), "bad_right"))
        .when(F.col("first").isNull(), F.concat(F.lit("parity "), "parity", F.lit(" is not a valid leading digit")))
    )
    value = F.concat(F.col("first").cast("string"), F.array_join(F.transform("l", lambda x: F.substring(x, 2, 1)), ""), F.array_join("r", ""))
    out = out.withColumn("reason", reason).withColumn("value", F.when(F.col("reason").isNull(), value)).drop("left", "right", "l", "r", "parity", "bad_left", "bad_right", "first")
    width = F.bround((F.col("x1") - F.col("x0")) / config.EAN_MODULES, 4)
    expected = check_digit(F.substring("value", 1, 12))
    read = F.col("value").isNotNull()
    return out.withColumns({
        "check_digit_valid": expected == F.substring("value", 13, 1).cast("int"), "check_digit_expected": expected, "module_width_pt": F.when(read, width),
        "module_width_mm": F.when(read, F.bround(width * 25.4 / 72, 4)), "magnification_percent": F.when(read, F.bround(width * 25.4 / 72 / config.EAN_MODULE_MM * 100, 1)),
        "width_mm": mm(F.col("x1") - F.col("x0")),
    })


def encoded(code: Column) -> Column:
    """The 95 modules of a 13-digit code."""
    first = F.element_at(F.array(*map(F.lit, config.EAN_FIRST)), F.substring(code, 1, 1).cast("int") + 1)
    def of(table: list[str], i: int) -> Column:
        return F.element_at(F.array(*map(F.lit, table)), F.substring(code, i, 1).cast("int") + 1)
    left = [F.when(F.substring(first, i, 1) == "0", of(config.EAN_L, i + 1)).otherwise(of(config.EAN_G, i + 1)) for i in range(1, 7)]
    return F.concat(F.lit("101"), *left, F.lit("01010"), *[of(config.EAN_R, i) for i in range(8, 14)], F.lit("101"))


def drawn(df: DataFrame, keys: list[str], modules_: str, width: float = 1.0) -> DataFrame:
    """Bars of a module text: its runs of ones, width points a module, 20 pt high."""
    bars = df.select(*keys, F.posexplode(F.split(modules_, "")).alias("i", "m")).filter("m = '1'")
    w = Window.partitionBy(*keys).orderBy("i")
    bars = clusters.islands(bars.withColumn("p", F.lag("i").over(w)), keys, ["i"], F.col("i") - F.col("p") > 1)
    return bars.groupBy(*keys, "island").agg((F.min("i") * width).alias("x0"), ((F.max("i") + 1) * width).alias("x1")).withColumns({"y0": F.lit(0.0), "y1": F.lit(20.0)}).drop("island")
