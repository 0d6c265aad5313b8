"""Chunking of blocks and of markdown, as ordered folds within a document.

Where a boundary depends on what has been gathered so far no window function expresses it, so the
greedy passes fold a document's sorted rows with `aggregate`, in the JVM: documents are the unit of
parallelism, and rows carry only what the fold needs: places, sizes and kinds, never texts. A fold gives
the places at which groups begin, and a window turns them into group numbers. Everything else is windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import merge_lines, split_keeping, token_estimate

SECTION_MOST, COALESCE_MOST = 1024, 4096
BULLET, TABLE, BODY = 10, 100, 99


def classify(lines: DataFrame, doc: str, pos: str, line: str) -> DataFrame:
    """(doc, pos, line, kind, level) of lines that aren't blank: heading, table_sep, table, bullet or text.

    A line with a pipe is a table row if it looks like one or follows a table's line.
    """
    s = lines.select(F.col(doc).alias("doc"), F.col(pos).alias("pos"), F.trim(F.col(line)).alias("line")).where("line <> ''")
    x = F.col("line")
    pipes = F.regexp_count(x, F.lit(r"\|"))
    cells = F.size(F.filter(F.split(x, r"\|"), lambda c: F.trim(c) != ""))
    sure = F.when(x.rlike(r"^#{1,6}\s*.+"), "heading").when(x.rlike(r"^\|[\s\-:|]+\|$"), "table_sep").when((pipes >= 2) & (cells >= 2), "table").when(pipes == 0, F.when(x.rlike(r"^(\d+[.)、]|[-*+])\s+.+"), "bullet").otherwise("text"))
    s = s.withColumn("sure", sure)
    # A line with one pipe is undecided: it continues a table if the last decided line was one.
    last = F.last("sure", ignorenulls=True).over(Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    alone = F.when(x.rlike(r"^(\d+[.)、]|[-*+])\s+.+"), "bullet").otherwise("text")
    kind = F.coalesce("sure", F.when(last.isin("table", "table_sep"), "table").otherwise(alone))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("line", "^(#{1,6})", 1))).when(F.col("kind").isin("table", "table_sep"), TABLE).when(F.col("kind") == "bullet", BULLET).otherwise(BODY)
    return s.withColumn("kind", kind).withColumn("level", level).drop("sure")


def sections(lines: DataFrame) -> DataFrame:
    """A column section_id: the running count of headings at the document's section level less one; tables -1.

    The section level is 1 if a document has more than one top heading, else 2.
    """
    doc = Window.partitionBy("doc")
    tops = F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).over(doc)
    level = F.when(tops > 1, 1).otherwise(2)
    begins = F.when((F.col("kind") == "heading") & (F.col("level") == level), 1).otherwise(0)
    run = F.sum(begins).over(doc.orderBy("pos")) - 1
    return lines.withColumn("section_id", F.when(F.col("kind").isin("table", "table_sep"), -1).otherwise(run).cast("int"))


def islands(lines: DataFrame) -> DataFrame:
    """Consecutive table lines as one row: (doc, pos, text, kind, section_id)."""
    w = Window.partitionBy("doc").orderBy("pos")
    table = F.col("kind").isin("table", "table_sep")
    starts = F.when(table & F.coalesce(F.lag(table).over(w), F.lit(False)), 0).otherwise(1)
    s = lines.withColumn("starts", starts).withColumn("g", F.sum("starts").over(w))
    rows = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return s.groupBy("doc", "g").agg(F.min("pos").alias("pos"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"), F.when(F.min(F.when(table, "table").otherwise(F.col("kind"))) == "table", "table").otherwise(F.min("kind")).alias("kind"), F.min("section_id").alias("section_id")).drop("g")


def fold_groups(rows: DataFrame, key: str, order: list[str], fields: list[str], zero: Column, step) -> DataFrame:
    """The rows with their group's number g, given by a greedy pass over their document.

    step(acc, row) gives a struct whose field g is the row's group; acc begins as zero and carries what
    the pass has gathered. Only order and fields go through the pass, which keeps where groups begin;
    the other columns of rows stay where they are.
    """
    at = F.struct(*order)
    seq = F.array_sort(F.collect_list(F.struct(*order, *fields)))
    start = F.struct(zero.alias("s"), F.array().cast(f"array<{rows.select(at.alias('x')).schema['x'].dataType.simpleString()}>").alias("begin"))

    def one(acc: Column, row: Column) -> Column:
        s = step(acc["s"], row)
        here = F.struct(*[row[c].alias(c) for c in order])
        return F.struct(s.alias("s"), F.when(s["g"] != acc["s"]["g"], F.concat(acc["begin"], F.array(here))).otherwise(acc["begin"]).alias("begin"))

    begins = rows.groupBy(key).agg(F.aggregate(seq, start, one, lambda acc: acc["begin"]).alias("begin")).select(key, F.explode("begin").alias("_at"))
    begins = begins.select(key, *[F.col(f"_at.{c}").alias(c) for c in order], F.lit(1).alias("_new"))
    g = F.sum(F.coalesce("_new", F.lit(0))).over(Window.partitionBy(key).orderBy(*order)) - 1
    return rows.join(begins, [key, *order], "left").withColumn("g", g.cast("int")).drop("_new")


def _state(g: Column, n: Column, **more: Column) -> Column:
    return F.struct(g.cast("int").alias("g"), n.cast("long").alias("n"), *[v.alias(k) for k, v in more.items()])


def section_chunks(markdown: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, chunk_no, section_id, text, token_count): markdown cut at section headings, and where a chunk has 1024 tokens.

    The bound is tested before a line is added, so a chunk may exceed it by one line; tables are never cut.
    """
    lines = markdown.select(F.col(doc).alias("doc"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    rows = islands(sections(classify(lines, "doc", "pos", "line"))).withColumn("tokens", token_estimate(F.col("text")))

    def step(s: Column, r: Column) -> Column:
        new = (s["g"] < 0) | ((r["section_id"] != s["last"]) & (r["section_id"] != -1)) | (s["n"] >= SECTION_MOST)
        last = F.when(r["section_id"] > -1, r["section_id"]).otherwise(s["last"])
        return _state(F.when(new, s["g"] + 1).otherwise(s["g"]), F.when(new, r["tokens"]).otherwise(s["n"] + r["tokens"]), last=last.cast("int"))

    zero = _state(F.lit(-1), F.lit(0), last=F.lit(-2).cast("int"))
    got = fold_groups(rows, "doc", ["pos"], ["section_id", "tokens"], zero, step)
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    out = got.groupBy("doc", F.col("g").alias("chunk_no")).agg(F.min_by("section_id", "pos").alias("section_id"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
    return out.withColumn("token_count", token_estimate(F.col("text")))


def token_chunks(blocks: DataFrame, doc: str, pos: str, kind: str, content: str, size: int = 512, overlap_percent: float = 0.0, delimiters: str = "\n") -> DataFrame:
    """(doc, chunk_no, chunk_type, text, token_count): segments gathered until a chunk has more than size tokens less the overlap.

    Blocks that aren't text stand alone and end a chunk; token counts are the sums of the segments'.
    A chunk after a full one begins with the overlap's share of that one's end.
    """
    threshold = size * (100 - overlap_percent) / 100.0
    segs = F.when(F.col(kind) == "text", split_keeping(F.col(content), delimiters)).otherwise(F.array(F.coalesce(F.col(content), F.lit(""))))
    rows = blocks.select(F.col(doc).alias("doc"), F.col(pos).alias("pos"), F.when(F.col(kind) == "text", "text").otherwise(F.col(kind)).alias("kind"), F.posexplode(segs).alias("seg", "text"))
    rows = rows.withColumn("tokens", token_estimate(F.col("text")))

    def step(s: Column, r: Column) -> Column:
        new = (s["g"] < 0) | (r["kind"] != "text") | s["media"] | (s["n"] > threshold)
        return _state(F.when(new, s["g"] + 1).otherwise(s["g"]), F.when(new, r["tokens"]).otherwise(s["n"] + r["tokens"]), media=(r["kind"] != "text"))

    got = fold_groups(rows, "doc", ["pos", "seg"], ["kind", "tokens"], _state(F.lit(-1), F.lit(0), media=F.lit(False)), step)
    parts = F.array_sort(F.collect_list(F.struct("pos", "seg", "text")))
    out = got.groupBy("doc", F.col("g").alias("chunk_no")).agg(F.min("kind").alias("chunk_type"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"), F.sum("tokens").alias("token_count"))
    if overlap_percent > 0:
        w = Window.partitionBy("doc").orderBy("chunk_no")
        before = F.when((F.lag("chunk_type").over(w) == "text") & (F.col("chunk_type") == "text"), F.lag("text").over(w))
        cut = F.floor(F.length(before) * (100 - overlap_percent) / 100.0)
        out = out.withColumn("text", F.concat(F.coalesce(F.substring(before, (cut + 1).cast("int"), F.length(before)), F.lit("")), F.col("text")))
    return out.where(F.trim("text") != "")


def coalesce_ingest(chunks: DataFrame, doc: str, order: str, kind: str, tokens: str, most: int = COALESCE_MOST) -> DataFrame:
    """(doc, order, g): the merged chunk that each chunk goes to; neighbours of one type merge while their tokens fit."""
    rows = chunks.select(F.col(doc).alias("doc"), F.col(order).alias("pos"), F.col(kind).alias("kind"), F.col(tokens).cast("long").alias("tokens"))

    def step(s: Column, r: Column) -> Column:
        new = (s["g"] < 0) | ~(r["kind"].eqNullSafe(s["kind"])) | (s["n"] + r["tokens"] > most)
        return _state(F.when(new, s["g"] + 1).otherwise(s["g"]), F.when(new, r["tokens"]).otherwise(s["n"] + r["tokens"]), kind=r["kind"])

    zero = _state(F.lit(-1), F.lit(0), kind=F.lit(None).cast("string"))
    return fold_groups(rows, "doc", ["pos"], ["kind", "tokens"], zero, step).select("doc", "pos", "g")


def coalesce_graph(chunks: DataFrame, doc: str, order: str, text: str, most: int = COALESCE_MOST) -> DataFrame:
    """(doc, order, g): as above for any types, while the sum stays below the bound; larger chunks stand alone."""
    rows = chunks.select(F.col(doc).alias("doc"), F.col(order).alias("pos"), token_estimate(F.col(text)).alias("tokens"))

    def step(s: Column, r: Column) -> Column:
        new = (s["g"] < 0) | (s["n"] + r["tokens"] >= most)
        return _state(F.when(new, s["g"] + 1).otherwise(s["g"]), F.when(new, r["tokens"]).otherwise(s["n"] + r["tokens"]))

    return fold_groups(rows, "doc", ["pos"], ["tokens"], _state(F.lit(-1), F.lit(0)), step).select("doc", "pos", "g")


def short_line_titles(lines: DataFrame) -> DataFrame:
    """A column is_title: shorter than half of the document's mean, the next line 1.5 times as long; needs three lines."""
    w = Window.partitionBy("doc")
    size = F.length("line")
    nxt = F.lead(size).over(w.orderBy("pos"))
    is_title = (F.count("*").over(w) >= 3) & (size < 0.5 * F.avg(size).over(w)) & F.coalesce(nxt > 1.5 * size, F.lit(False))
    return lines.withColumn("is_title", is_title)


def title_paths(lines: DataFrame) -> DataFrame:
    """A column path: the headings a line stands under, joined by ' > '; a heading ends those of its level and below."""
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heads = lines
    for k in range(1, 7):
        mark = F.when((F.col("kind") == "heading") & (F.col("level") <= k), F.struct(F.col("level").alias("l"), F.regexp_replace("line", r"^#{1,6}\s*", "").alias("t")))
        heads = heads.withColumn(f"_h{k}", F.last(mark, ignorenulls=True).over(w))
    parts = [F.when(F.col(f"_h{k}.l") == k, F.col(f"_h{k}.t")) for k in range(1, 7)]
    return heads.withColumn("path", F.concat_ws(" > ", *parts)).drop(*[f"_h{k}" for k in range(1, 7)])


def outline_titles(lines: DataFrame, outline: DataFrame, least: float = 0.8) -> DataFrame:
    """Lines with the level of the first outline title (doc, title, level, nth) they resemble; null for none."""
    from siftwell.functions.text import char_similarity

    got = lines.join(outline, "doc").where(char_similarity(F.lower(F.trim("line")), F.lower(F.trim("title"))) > least)
    first = got.groupBy("doc", "pos").agg(F.min_by(outline["level"], "nth").alias("outline_level"))
    return lines.join(first, ["doc", "pos"], "left")


def outline_decides(lines: DataFrame, least: float = 0.03) -> DataFrame:
    """(doc, decides): whether an outline gives levels to more than so large a share of a document's lines, so that its levels are used; lines: of outline_titles."""
    return lines.groupBy("doc").agg((F.count("outline_level") > F.lit(least) * F.count("*")).alias("decides"))


def line_records(blocks: DataFrame, doc: str, pos: str, kind: str, content: str) -> DataFrame:
    """(doc, pos, nth, line): text blocks' lines, incomplete ones merged; a mark for each image or table."""
    rows = F.when(F.col(kind) == "text", merge_lines(F.split(F.col(content), "\n"))).when(F.col(kind) == "image", F.array(F.concat(F.lit("[Image: "), F.col(content), F.lit("]")))).otherwise(F.array(F.concat(F.lit("[Table: "), F.substring(F.col(content), 1, 100), F.lit("...]"))))
    return blocks.select(F.col(doc).alias("doc"), F.col(pos).alias("pos"), F.posexplode(rows).alias("nth", "line"))


def media_context(chunks: DataFrame, size: int) -> DataFrame:
    """Columns context_above and context_below of chunks that aren't text: up to size tokens of the text chunk beside them."""
    w = Window.partitionBy("doc").orderBy("chunk_no")
    text = F.when(F.col("chunk_type") == "text", F.col("text"))
    above, below = F.lag(text).over(w), F.lead(text).over(w)
    chars = size * 4
    tail = F.substring(above, F.greatest(F.lit(1), F.length(above) - chars + 1).cast("int"), F.lit(chars))
    media = F.col("chunk_type") != "text"
    return chunks.withColumn("context_above", F.when(media, F.coalesce(tail, F.lit("")))).withColumn("context_below", F.when(media, F.coalesce(F.substring(below, 1, chars), F.lit(""))))


def dispatch(blocks: DataFrame, doc: str, pos: str, source: Column, kind: str, content: str) -> DataFrame:
    """(doc, by_section): whether a document goes to the section chunker or to the token chunker.

    It goes by sections if it is markdown, one block of text, and has headings of several levels or
    several of the first; lists and tables count as levels of their own, as classify numbers them.
    """
    one = blocks.groupBy(F.col(doc).alias("doc")).agg(F.count("*").alias("n"), F.max(F.col(kind) == "text").alias("text"))
    single = one.where("n = 1 and text").join(is_markdown(blocks, doc, source, kind, content).where("markdown"), "doc", "left_semi")
    lines = blocks.select(F.col(doc).alias("doc"), F.posexplode(F.split(F.col(content), "\n")).alias("pos", "line")).join(single.select("doc"), "doc", "left_semi")
    levels = classify(lines, "doc", "pos", "line").where(F.col("level") != BODY).groupBy("doc")
    cut = levels.agg(((F.countDistinct("level") > 1) | (F.sum(F.when(F.col("level") == 1, 1).otherwise(0)) > 1)).alias("by_section"))
    return one.join(cut, "doc", "left").select("doc", F.coalesce("by_section", F.lit(False)).alias("by_section"))


def chunks(blocks: DataFrame, doc: str, pos: str, source: Column, kind: str, content: str, size: int = 512, overlap_percent: float = 0.0) -> DataFrame:
    """(doc, chunk_no, chunk_type, text, token_count, method) of all documents, each by the chunker it is dispatched to."""
    way = dispatch(blocks, doc, pos, source, kind, content).withColumnRenamed("doc", "_doc")
    rows = blocks.join(way, F.col(doc) == F.col("_doc"))
    by_section = section_chunks(rows.where("by_section").drop("_doc", "by_section"), doc, content)
    by_tokens = token_chunks(rows.where("not by_section").drop("_doc", "by_section"), doc, pos, kind, content, size, overlap_percent)
    a = by_section.select("doc", "chunk_no", F.lit("text").alias("chunk_type"), "text", F.col("token_count").cast("long").alias("token_count"), F.lit("section").alias("method"))
    return a.unionByName(by_tokens.select("doc", "chunk_no", "chunk_type", "text", F.col("token_count").cast("long").alias("token_count"), F.lit("token").alias("method")))


def is_markdown(blocks: DataFrame, doc: str, source: Column, kind: str, content: str) -> DataFrame:
    """(doc, markdown): a block says that it was converted, or the only block is text with a heading."""
    marked = F.max(source == "converted_markdown")
    heading = F.max((F.col(kind) == "text") & F.col(content).rlike(r"(?m)^#{1,6}\s+"))
    return blocks.groupBy(F.col(doc).alias("doc")).agg((F.coalesce(marked, F.lit(False)) | ((F.count("*") == 1) & F.coalesce(heading, F.lit(False)))).alias("markdown"))
