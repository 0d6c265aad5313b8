"""Page layout: words to lines, tables against images, running headers and footers, font levels."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.geometry import drawing_page, inside_ratio, max_overlap
from siftwell.functions.text import margin_form, page_marker


# What the steadiness of a margin's cluster is measured against and must exceed, in points and shares.
PAGE_WIDTH, PAGE_HEIGHT = 600.0, 800.0
STEADY_MARKER, STEADY_SHORT, STEADY_IMAGE, EDGE = 0.7, 0.8, 0.75, 0.3


def box(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])


def group_words(words: DataFrame, line: float = 5.0, font: float = 2.0) -> DataFrame:
    """(doc, page, nth, text, x0, y0, x1, y1, font_size): words in reading order joined while near their block's first word.

    words: (doc, page, text, top, bottom, x0, x1, size). Blank words are left out.
    """
    seq = F.array_sort(F.collect_list(F.struct("top", "x0", "text", "bottom", "x1", "size")))
    start = F.struct(F.lit(-1).alias("g"), F.lit(0.0).alias("top"), F.lit(0.0).alias("size"), F.array().cast("array<int>").alias("gs"))

    def step(a: Column, w: Column) -> Column:
        new = (a["g"] < 0) | (F.abs(w["top"] - a["top"]) > line) | (F.abs(w["size"] - a["size"]) > font)
        g = F.when(new, a["g"] + 1).otherwise(a["g"])
        return F.struct(g.alias("g"), F.when(new, w["top"]).otherwise(a["top"]).alias("top"), F.when(new, w["size"]).otherwise(a["size"]).alias("size"), F.concat(a["gs"], F.array(g)).alias("gs"))

    got = words.where(F.trim("text") != "").groupBy("doc", "page").agg(seq.alias("seq")).withColumn("gs", F.aggregate("seq", start, step, lambda a: a["gs"]))
    rows = got.select("doc", "page", F.posexplode(F.arrays_zip("seq", "gs")).alias("i", "x")).select("doc", "page", "i", "x.gs", "x.seq.*")
    parts = F.array_sort(F.collect_list(F.struct("i", F.trim("text").alias("t"))))
    return rows.groupBy("doc", "page", F.col("gs").alias("nth")).agg(
        F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"), F.min("x0").alias("x0"), F.min("top").alias("y0"), F.max("x1").alias("x1"), F.max("bottom").alias("y1"), F.min_by("size", "i").alias("font_size")
    )


def without_covered(boxes: DataFrame, others: DataFrame, least: float = 0.90, either: bool = False) -> DataFrame:
    """Boxes of a page that no other box of it covers; both have (doc, page, box). either: the greater share of the two."""
    o = others.select(F.col("doc").alias("_d"), F.col("page").alias("_p"), F.col("box").alias("_b"))
    share = max_overlap(F.col("box"), F.col("_b")) if either else inside_ratio(F.col("box"), F.col("_b"))
    return boxes.join(o, (F.col("doc") == F.col("_d")) & (F.col("page") == F.col("_p")) & (share > least), "left_anti")


def valid_table(rows: Column) -> Column:
    """Whether rows of cells are a table: two rows, more than one column, two columns with content, or two columns in all."""
    wide = F.array_max(F.transform(rows, lambda r: F.size(r)))
    full = F.size(F.filter(F.sequence(F.lit(1), wide), lambda i: F.exists(rows, lambda r: F.trim(F.coalesce(F.try_element_at(r, i), F.lit(""))) != "")))
    return (F.size(rows) >= 2) & (wide > 1) & ((full >= 2) | ((wide == 2) & (full >= 1)))


def table_text(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")), "\n")


def running_text(blocks: DataFrame, heights: DataFrame, top: float = 0.1, bottom: float = 0.1, least: float = 0.5) -> DataFrame:
    """(id): header and footer blocks: within a margin zone, in one place with one text on so many of a document's pages, or a page marker.

    blocks: (id, doc, page, text, y0, y1); heights: (doc, page, height). A text's place is its middle's
    share of the page height, in hundredths; repeats are counted by (document, zone, place) and by text.
    """
    b = blocks.join(heights, ["doc", "page"])
    zone = F.when(F.col("y1") <= top * F.col("height"), "top").when(F.col("y0") >= (1 - bottom) * F.col("height"), "bottom")
    b = b.select("id", "doc", "page", "text", zone.alias("zone"), F.round(50 * (F.col("y0") + F.col("y1")) / F.col("height")).alias("place"), margin_form(F.col("text")).alias("form")).where("zone is not null")
    pages = heights.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    at = b.groupBy("doc", "zone", "place").agg(F.countDistinct("page").alias("here"))
    as_text = b.groupBy("doc", "zone", "form").agg(F.countDistinct("page").alias("alike"))
    j = b.join(pages, "doc").join(at, ["doc", "zone", "place"]).join(as_text, ["doc", "zone", "form"])
    enough = F.greatest(F.lit(2.0), F.lit(least) * F.col("pages"))
    return j.where((F.col("alike") >= enough) | ((F.col("here") >= enough) & page_marker(F.col("text")))).select("id").distinct()


def seed_clusters(boxes: DataFrame, flat: bool, least: float = 0.5) -> DataFrame:
    """(doc, zone, x0, y0, x1, y1, cluster) of different boxes (..., a, b, c), ordered by the last: the first box left takes every other that overlaps it enough.

    flat: by horizontal extent alone. A group holds the different boxes of one file's margin, few by nature
    and never its pages.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["a", "b", "c"], ignore_index=True)
        x0, y0, x1, y1 = (g[c].to_numpy("float64") for c in ("x0", "y0", "x1", "y1"))
        cluster = np.full(len(g), -1)
        for k in range(len(g)):
            if cluster[k] >= 0:
                continue
            w = np.maximum(0, np.minimum(x1[k], x1) - np.maximum(x0[k], x0))
            if flat:
                both, every = w, np.maximum(x1[k], x1) - np.minimum(x0[k], x0)
                alike = (x1 - x0 >= 1) & (x1[k] - x0[k] >= 1) & (both > least * np.maximum(every, 1e-9))
            else:
                both = w * np.maximum(0, np.minimum(y1[k], y1) - np.maximum(y0[k], y0))
                every = (x1[k] - x0[k]) * (y1[k] - y0[k]) + (x1 - x0) * (y1 - y0) - both
                alike = both > least * np.maximum(every, 1e-9)
            cluster[(cluster < 0) & alike] = k
            cluster[k] = k
        return g.assign(cluster=cluster)[["doc", "zone", "x0", "y0", "x1", "y1", "cluster"]]

    return boxes.groupBy("doc", "zone").applyInPandas(run, "doc string, zone string, x0 double, y0 double, x1 double, y1 double, cluster int")


def _clustered(rows: DataFrame, box: list[str], flat: bool) -> DataFrame:
    """Rows (doc, zone, at, x0, y0, x1, y1) with their cluster; box: the coordinates that tell boxes apart."""
    named = {c: F.col(c) if c in box else F.lit(0.0) for c in ("x0", "y0", "x1", "y1")}
    keyed = rows.withColumns({f"_{c}": v for c, v in named.items()})
    different = keyed.groupBy("doc", "zone", *[F.col(f"_{c}").alias(c) for c in named]).agg(F.min("at").alias("at")).select("doc", "zone", *named, "at.*")
    clusters = seed_clusters(different, flat).select("doc", "zone", *[F.col(c).alias(f"_{c}") for c in named], "cluster")
    return keyed.join(clusters, ["doc", "zone", *[f"_{c}" for c in named]]).drop(*[f"_{c}" for c in named])


def _zones(y0: Column, y1: Column, height: Column, top: float, bottom: float) -> Column:
    """The margin zones a box reaches into."""
    both = F.array(F.when(y0 <= top * height, "top"), F.when(y1 >= (1 - bottom) * height, "bottom"))
    return F.explode(F.filter(both, lambda z: z.isNotNull())).alias("zone")


def margin_blocks(blocks: DataFrame, heights: DataFrame, top: float = 0.1, bottom: float = 0.1, pages: int = 2, longest: int = 160) -> DataFrame:
    """(id) of text blocks that are headers or footers: clusters of one extent in a margin zone on several pages.

    A cluster goes if it stands steadily and has a page marker, or if it repeats a text, or stands steadily
    and is short, and has a marker or stands close to the page's edge. blocks: (id, doc, page, text, x0, y0, x1, y1).
    """
    h = heights.groupBy("doc", "page").agg(F.max("height").alias("height"))
    rows = blocks.join(h, ["doc", "page"]).where("height > 0").select("id", "doc", "page", "text", "x0", "y0", "x1", "y1", "height", F.struct(F.col("page").alias("a"), F.col("y0").alias("b"), F.col("id").alias("c")).alias("at"), _zones(F.col("y0"), F.col("y1"), F.col("height"), top, bottom))
    rows = _clustered(rows, ["x0", "x1"], True).withColumn("form", margin_form(F.col("text")))
    key = ["doc", "zone", "cluster"]
    repeats = rows.where("form <> ''").groupBy(*key, "form").agg(F.count("*").alias("n")).groupBy(*key).agg(F.max("n").alias("repeats"))
    width = F.col("x1") - F.col("x0")
    steady = 0.7 * F.greatest(F.lit(0.0), 1 - F.stddev_pop("x0") / PAGE_WIDTH) + 0.3 * F.when(F.avg(width) > 0, F.greatest(F.lit(0.0), 1 - F.stddev_pop(width) / F.avg(width))).otherwise(0.0)
    one = rows.groupBy(*key).agg(
        F.countDistinct("page").alias("on"), steady.alias("steady"), F.max(page_marker(F.col("text"))).alias("marker"), F.avg(F.length(F.trim("text"))).alias("size"),
        F.avg("y0").alias("y0"), F.avg("y1").alias("y1"), F.min_by("height", "at").alias("height"),
    ).join(repeats, key, "left")
    edge = (F.col("y0") <= EDGE * top * F.col("height")) | (F.col("y1") >= (1 - EDGE * bottom) * F.col("height"))
    repeated = (F.coalesce("repeats", F.lit(0)) >= pages) | ((F.col("steady") > STEADY_SHORT) & (F.col("size") <= longest))
    gone = one.where((F.col("on") >= pages) & (((F.col("steady") > STEADY_MARKER) & F.col("marker")) | (repeated & (F.col("marker") | edge))))
    return rows.join(gone.select(*key), key, "left_semi").select("id").distinct()


def margin_images(images: DataFrame, heights: DataFrame, top: float = 0.1, bottom: float = 0.1, pages: int = 2, small: float = 0.05, width: float = 595.0) -> DataFrame:
    """(id) of images that are repeated logos: clusters of overlapping boxes in a margin zone on several pages, all small and steady. images: (id, doc, page, box)."""
    h = heights.groupBy("doc", "page").agg(F.max("height").alias("height"))
    b = F.col("box")
    rows = images.join(h, ["doc", "page"]).select("id", "doc", "page", *[b[c].alias(c) for c in ("x0", "y0", "x1", "y1")], "height", F.struct(F.col("page").alias("a"), b["y0"].alias("b"), F.col("id").alias("c")).alias("at"))
    rows = rows.select("*", _zones(F.col("y0"), F.col("y1"), F.col("height"), top, bottom))
    rows = _clustered(rows, ["x0", "y0", "x1", "y1"], False)
    key = ["doc", "zone", "cluster"]
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    spread = lambda c, by: F.greatest(F.lit(0.0), 1 - F.stddev_pop(c) / by)
    steady = 0.4 * spread("x0", F.lit(PAGE_WIDTH)) + 0.4 * spread("y0", F.lit(PAGE_HEIGHT)) + 0.1 * spread(wide, F.greatest(F.lit(1.0), F.max(wide))) + 0.1 * spread(high, F.greatest(F.lit(1.0), F.max(high)))
    one = rows.groupBy(*key).agg(F.countDistinct("page").alias("on"), steady.alias("steady"), F.max(wide * high).alias("area"), F.min_by("height", "at").alias("height"))
    gone = one.where((F.col("on") >= pages) & (F.col("steady") > STEADY_IMAGE) & (F.col("area") <= small * width * F.col("height")))
    return rows.join(gone.select(*key), key, "left_semi").select("id").distinct()


def surrounding(images: DataFrame, blocks: DataFrame, budget: int = 200) -> DataFrame:
    """(image, side, nth, text): the page's text above and below an image, nearest first, half the budget of tokens each side."""
    t = blocks.where(~page_marker(F.col("text"))).select("doc", "page", "text", F.col("y0").alias("ty0"), F.col("y1").alias("ty1"))
    j = images.join(t, ["doc", "page"])
    side = F.when(F.col("ty1") <= F.col("box.y0"), "above").when(F.col("ty0") >= F.col("box.y1"), "below")
    gap = F.when(side == "above", F.col("box.y0") - F.col("ty1")).otherwise(F.col("ty0") - F.col("box.y1"))
    j = j.select("image", side.alias("side"), gap.alias("gap"), "text").where("side is not null")
    w = Window.partitionBy("image", "side").orderBy("gap", "text")
    used = F.coalesce(F.sum(F.greatest(F.lit(1), F.floor(F.length("text") / 4))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return j.select("image", "side", F.row_number().over(w).alias("nth"), "text", used.alias("used")).where(F.col("used") < budget / 2).drop("used")


def font_levels(spans: DataFrame, most: int = 6, least: int = 3) -> DataFrame:
    """(doc, size, level): sizes above a document's most frequent one, greatest first; rarer ones fill up where there are few."""
    n = spans.where("font_size is not null").groupBy("doc", F.round("font_size", 1).alias("size")).agg(F.count("*").alias("n"))
    body = n.groupBy("doc").agg(F.max_by("size", F.struct("n", "size")).alias("body"))
    j = n.join(body, "doc")
    larger = j.where("size > body")
    have = larger.groupBy("doc").agg(F.count("*").alias("have"))
    fill = j.where("size < body").join(have, "doc", "left").where(F.coalesce("have", F.lit(0)) < least)
    fill = fill.withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy("n", F.desc("size")))).where(F.col("k") <= least)
    every = larger.select("doc", "size").unionByName(fill.select("doc", "size"))
    level = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("size")))
    return every.select("doc", "size", level.alias("level")).where(F.col("level") <= most)


def reading_order(blocks: DataFrame) -> DataFrame:
    """A column nth: by page, top, left, given position; missing tops last."""
    return blocks.withColumn("nth", F.row_number().over(Window.partitionBy("doc").orderBy(F.coalesce("page", F.lit(0)), F.coalesce("y0", "y1", F.lit(float("inf"))), F.coalesce("x0", F.lit(0.0)), "pos")))


def page_content(words: DataFrame, images: DataFrame, tables: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, page, nth, kind, content): what a parser read of pages, laid out.

    Drawings are kept as one image of the page; words become lines; tables that aren't valid or lie in an
    image are left out, as are lines that a table covers and what runs in the margins; the rest stands in
    reading order. words: (doc, page, text, top, bottom, x0, x1, size); images: (id, doc, page, box, path);
    tables: (id, doc, page, box, rows); pages: (doc, page, width, height, strokes, path).
    """
    drawn = pages.withColumn("drawing", drawing_page(F.col("strokes"), F.col("width"), F.col("height")))
    plain = drawn.where("not drawing").select("doc", "page")
    lines = group_words(words.join(plain, ["doc", "page"], "left_semi")).select("*", F.concat_ws("-", "doc", "page", "nth").alias("id"), F.struct("x0", "y0", "x1", "y1").alias("box"))
    kept_tables = without_covered(tables.join(plain, ["doc", "page"], "left_semi").where(valid_table(F.col("rows"))), images)
    heights = pages.select("doc", "page", "height")
    text = lines.join(margin_blocks(lines, heights), "id", "left_anti")
    text = without_covered(text, kept_tables, 0.8 - 1e-9, either=True)
    figures = images.join(plain, ["doc", "page"], "left_semi").join(margin_images(images, heights), "id", "left_anti")
    parts = [
        text.select("doc", "page", "box", F.lit("text").alias("kind"), F.col("text").alias("content"), "id"),
        kept_tables.select("doc", "page", "box", F.lit("table").alias("kind"), table_text(F.col("rows")).alias("content"), "id"),
        figures.select("doc", "page", "box", F.lit("image").alias("kind"), F.col("path").alias("content"), "id"),
        drawn.where("drawing").select("doc", "page", F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1")).alias("box"), F.lit("image").alias("kind"), F.col("path").alias("content"), F.lit("").alias("id")),
    ]
    rows = reduce(DataFrame.unionByName, parts).select("doc", "page", "kind", "content", F.col("id").alias("pos"), "box.*")
    return reading_order(rows).select("doc", "page", "nth", "kind", "content")
