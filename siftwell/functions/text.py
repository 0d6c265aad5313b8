"""Text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BULLETS = "•‣◦⁃∙"
MODALITIES = {"title": "text", "text": "text", "table": "structured", "image": "visual", "equation": "mathematical", "code": "text"}
LANGUAGE_NAMES = {"en": "English", "zh": "Chinese", "ja": "Japanese", "ko": "Korean", "es": "Spanish", "fr": "French", "de": "German"}
TITLE_PATTERNS = (r"^#{1,6}\s+\S", r"^\d+\.\s+\S", r"^[A-Z][A-Z\s]{2,}$", r"^\s{0,4}[A-Z][\p{L}\p{N}_\s]{0,50}[:\.]?$")
PAGE_MARKERS = (
    r"^[-–—\s\d/]{1,12}$",
    r"^(page|p\.?)[\s#:.-]*[\divxlcdm]+(?:\s*(?:/|of)\s*[\divxlcdm]+)?$",
    r"^第\s*[\divxlcdm]+\s*页$",
    r"^[\divxlcdm]+\s*/\s*[\divxlcdm]+$",
)
WORD = r"[\p{L}\p{N}_]+"
SENTENCE = r"[^.。！？!?；;:\n]*[.。！？!?；;:\n]|[^.。！？!?；;:\n]+$"


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-case words of at least `least` characters."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.length(w) >= least)


def token_estimate(text: Column) -> Column:
    """Characters over four, at least 1 unless the text is empty or null."""
    n = F.length(text)
    return F.when(text.isNull() | (n == 0), 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def detect_language(text: Column) -> Column:
    """A language by the first hundred characters: script first, then telling letters, else English."""
    head = F.lower(F.substring(text, 1, 100))
    return (
        F.when(head.rlike("[一-鿿]"), "zh").when(head.rlike("[぀-ヿ]"), "ja").when(head.rlike("[가-힯]"), "ko")
        .when(head.rlike("[ñ¿¡]|que"), "es").when(head.rlike("[çœù]"), "fr").when(head.rlike("[äöüß]"), "de").otherwise("en")
    )


def query_terms(text: Column) -> Column:
    """Sorted distinct Latin words of two characters or more, and runs of Han with their 2- to 4-grams."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit("[a-z0-9_]{2,}"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit("[一-鿿]+"), F.lit(0))

    def grams(n: int) -> Column:
        long = F.filter(runs, lambda r: F.length(r) >= n)
        return F.flatten(F.transform(long, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: F.substring(r, i, F.lit(n)))))

    return F.array_sort(F.array_distinct(F.concat(words, runs, grams(2), grams(3), grams(4))))


def modality(kind: Column) -> Column:
    """The modality of a chunk type; unknown ones are text."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in MODALITIES.items() for x in kv]), kind), F.lit("text"))


def block_type(kind: Column) -> Column:
    return F.when(kind.isin("text", "image", "table", "equation", "code", "chart", "diagram"), kind).otherwise("text")


def language_tag(text: Column, lang: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    return F.concat(F.lit("["), F.coalesce(F.element_at(names, lang), lang), F.lit("] "), text)


def embedding_text(kind: Column, content: Column) -> Column:
    """What is embedded: text as it is, else its type and first 500 characters."""
    return F.when(kind == "text", content).otherwise(F.concat(kind, F.lit(": "), F.substring(content, 1, 500)))


def snippet(content: Column, most: int = 240) -> Column:
    return F.regexp_replace(F.substring(content, 1, most), "\n", " ")


def clean_bullets(text: Column) -> Column:
    """One bullet glyph, no zero-width characters; null as empty."""
    one = F.translate(F.replace(F.coalesce(text, F.lit("")), F.lit("\\uf06c"), F.lit("•")), BULLETS, "•" * len(BULLETS))
    return F.regexp_replace(one, "[​﻿]", "")


def likely_title(line: Column) -> Column:
    s = F.trim(line)
    short = (F.length(s) < 20) & (F.length(s) > 1) & (F.upper(s) == s) & (F.lower(s) != s)
    return (s != "") & (reduce(lambda a, b: a | b, [s.rlike(p) for p in TITLE_PATTERNS]) | short)


def char_similarity(a: Column, b: Column) -> Column:
    """Share of equal characters at equal places, of the longer text's length; 0 if either is empty."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 1).otherwise(0))
    most = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(F.aggregate(same, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) / most)


def sentences(text: Column) -> Column:
    """Sentences with their delimiters, blank ones left out."""
    return F.filter(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s) != "")


def split_keeping(text: Column, delimiters: str) -> Column:
    """Segments that end with one of some single-character delimiters; blank ones left out."""
    d = "".join("\\" + c if c in "\\]^-[" else c for c in delimiters)
    return F.filter(F.regexp_extract_all(text, F.lit(f"[^{d}]+[{d}]?"), F.lit(0)), lambda s: F.length(F.regexp_replace(s, r"\s", "")) > 0)


def margin_form(text: Column) -> Column:
    """What a header or footer is compared by: lower case, digits as #, no marks."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+", " "), r"\d+", "#")
    s = F.regexp_replace(s, r"[^\p{L}\p{N}_\s#]", " ")
    return F.substring(F.trim(F.regexp_replace(s, r"\s+", " ")), 1, 240)


def page_marker(text: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+", " ")
    return (s == "") | reduce(lambda a, b: a | b, [s.rlike(p) for p in PAGE_MARKERS])


def table_cells(text: Column) -> Column:
    """Rows of cells of a table's text: cells split at ' | ', else tab, else comma; blank lines left out."""
    lines = F.filter(F.split(text, "\n"), lambda s: F.trim(s) != "")

    def cells(line: Column) -> Column:
        at = F.when(line.contains(" | "), F.split(line, r" \| ")).when(line.contains("\t"), F.split(line, "\t")).otherwise(F.split(line, ","))
        return F.transform(at, lambda c: F.trim(c))

    return F.array_distinct(F.transform(lines, cells))


def table_markdown(text: Column) -> Column:
    """A table's text as a markdown table: repeated rows dropped, rows cut or filled to the header's width."""
    rows = table_cells(text)
    wide = F.size(F.element_at(rows, 1))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: line(F.slice(F.concat(r, F.array_repeat(F.lit(""), wide)), 1, wide)))
    rule = line(F.array_repeat(F.lit("---"), wide))
    return F.when(F.size(rows) < 1, text).otherwise(F.array_join(F.concat(F.array(line(F.element_at(rows, 1)), rule), body), "\n"))


def table_stats(text: Column) -> tuple[Column, Column]:
    """(rows, columns): lines that aren't blank, and cells that aren't blank in the first line."""
    lines = F.filter(F.split(text, "\n"), lambda s: F.trim(s) != "")
    first = F.coalesce(F.try_element_at(F.split(text, "\n"), F.lit(1)), F.lit(""))
    return F.size(lines), F.size(F.filter(F.split(first, r"\|"), lambda c: F.trim(c) != ""))


def text_stats(text: Column) -> tuple[Column, Column, Column]:
    """(sentences, characters, first sentence's first 200 characters), sentences being split at full stops."""
    s = F.filter(F.transform(F.split(text, r"\."), lambda x: F.trim(x)), lambda x: x != "")
    return F.size(s), F.length(text), F.substring(F.coalesce(F.try_element_at(s, F.lit(1)), F.lit("")), 1, 200)


def describe(kind: Column, content: Column) -> Column:
    """A description of a block that isn't text."""
    lines = F.size(F.filter(F.split(content, "\n"), lambda s: F.trim(s) != ""))
    return (
        F.when(kind == "image", F.concat(F.lit("Image: "), content))
        .when(kind == "table", F.concat(F.lit("Table: "), F.substring(content, 1, 500)))
        .when(kind == "equation", F.concat(F.lit("Equation: "), F.substring(content, 1, 100)))
        .when(kind == "code", F.concat(F.lit("Code ("), lines.cast("string"), F.lit(" lines): "), F.substring(content, 1, 200)))
        .otherwise(content)
    )


def rerank_scores(reply: Column, n: int) -> Column:
    """Scores in a model's reply: floats after its last colon, filled with 0.5 and cut to n; all 0.5 if any isn't a number."""
    tail = F.element_at(F.split(reply, ":"), -1)
    got = F.transform(F.split(tail, ","), lambda s: F.trim(s).try_cast("double"))
    bad = F.exists(got, lambda x: x.isNull()) | reply.isNull()
    half = F.array_repeat(F.lit(0.5), n)
    return F.when(bad, half).otherwise(F.slice(F.concat(got, half), 1, n))


def escape_literal(text: Column) -> Column:
    """Backslashes and quotes escaped, line ends as spaces."""
    return F.regexp_replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), "\n", " ")


def merge_lines(lines: Column) -> Column:
    """Lines joined with the next while they end in a letter or digit and the next is neither blank nor a title."""
    trimmed = F.transform(lines, lambda s: F.trim(s))
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, s: Column) -> Column:
        grows = (acc["cur"] != "") & acc["cur"].rlike(r"[\p{L}\p{N}]$") & (s != "") & ~likely_title(s)
        flushed = F.when(acc["cur"] != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
        return F.when(grows, F.struct(F.concat(acc["cur"], F.lit(" "), s).alias("cur"), acc["done"].alias("done"))).otherwise(F.struct(s.alias("cur"), flushed.alias("done")))

    end = lambda acc: F.when(acc["cur"] != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
    return F.aggregate(trimmed, start, step, end)
