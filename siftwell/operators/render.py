"""Rendering: blocks to markdown, level hints of lines, prompts as string columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import clean_bullets, table_markdown

# Layout labels that mark a heading.
HEADING_LABELS = ("title", "section", "head", "chapter")


def layout_hint(layout_type: Column, layoutno: Column, content: Column, short: int = 50) -> Column:
    """The level a block's layout hints at: its layout number for a heading's label, 2 for text that isn't short, else null."""
    label = reduce(lambda a, b: a | b, [F.lower(layout_type).contains(x) for x in HEADING_LABELS])
    return F.when(label, layoutno).when(layout_type.isNotNull() & (F.length(content) >= short), 2)


def block_markdown(kind: Column, content: Column, level: Column) -> Column:
    """One block as markdown: text under its heading level if it has one, tables, images, code and equations in their marks."""
    text = clean_bullets(content)
    return (
        F.when(kind == "table", table_markdown(text))
        .when(kind == "image", F.concat(F.lit("!["), F.regexp_replace(text, r"^.*/", ""), F.lit("]("), text, F.lit(")")))
        .when(kind == "code", F.concat(F.lit("```\n"), text, F.lit("\n```")))
        .when(kind == "equation", F.concat(F.lit("$$"), text, F.lit("$$")))
        .when(level.between(1, 6), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text))
        .otherwise(text)
    )


def document_markdown(blocks: DataFrame) -> DataFrame:
    """(doc, markdown): a document's blocks in order; blocks: (doc, pos, kind, content, level)."""
    rows = F.array_sort(F.collect_list(F.struct("pos", block_markdown(F.col("kind"), F.col("content"), F.col("level")).alias("m"))))
    return blocks.groupBy("doc").agg(F.array_join(F.transform(rows, lambda r: r["m"]), "\n\n").alias("markdown"))


def pattern_hints(lines: DataFrame) -> DataFrame:
    """A column hint: a markdown heading's level; numbered and upper-case lines get their form's ordinal by first occurrence in the document."""
    s = F.trim("line")
    form = F.when(s.rlike(r"^#{1,6}\s+\S"), "markdown").when(s.rlike(r"^\d+\.\s+\S"), "numbered").when(s.rlike(r"^[A-Z][A-Z\s]{2,}$"), "uppercase")
    rows = lines.withColumn("form", form)
    first = rows.where("form in ('numbered', 'uppercase')").groupBy("doc", "form").agg(F.min("pos").alias("first"))
    first = first.select("doc", "form", F.row_number().over(Window.partitionBy("doc").orderBy("first")).alias("ordinal"))
    out = rows.join(first, ["doc", "form"], "left")
    return out.withColumn("hint", F.when(F.col("form") == "markdown", F.length(F.regexp_extract(s, "^(#+)", 1))).otherwise(F.col("ordinal")).cast("int")).drop("ordinal")


def place_consistency(blocks: DataFrame, keys: list[str], x_weight: float = 0.3, y_weight: float = 0.7) -> DataFrame:
    """How steadily the blocks of a cluster stand: one less the spread of their middles, by page height and by width, weighted."""
    y = F.stddev_pop((F.col("y0") + F.col("y1")) / 2 / F.col("height"))
    x = F.stddev_pop((F.col("x0") + F.col("x1")) / 2 / F.greatest(F.lit(1.0), F.col("width")))
    score = y_weight * (1 - F.least(F.lit(1.0), y)) + x_weight * (1 - F.least(F.lit(1.0), x))
    return blocks.groupBy(*keys).agg(score.alias("consistency"), F.count("*").alias("n"))


def extraction_prompt(content: Column, types: list[str], lang: str = "English") -> Column:
    """Asks a model for entities and relations in the line format that the parsers read."""
    return F.concat(
        F.lit(f"List the entities of the types {', '.join(types)} in the text below, then their relations, in {lang}. One a line:\n"
              "entity<|#|>name<|#|>type<|#|>description\nrelation<|#|>source<|#|>target<|#|>keywords<|#|>description\nEnd with <|COMPLETE|>.\n\nText:\n"),
        content,
    )


def summary_prompt(name: Column, descriptions: Column) -> Column:
    return F.concat(F.lit("Merge these descriptions of "), name, F.lit(" into one:\n- "), F.array_join(descriptions, "\n- "))


def rerank_prompt(query: Column, contents: Column) -> Column:
    """Asks for one score from 0 to 1 for each passage; contents: an array."""
    return F.concat(F.lit("Score each passage's relevance to the query from 0 to 1, separated by commas.\nQuery: "), query, F.lit("\n"), F.array_join(F.transform(contents, lambda c, k: F.concat((k + 1).cast("string"), F.lit(". "), c)), "\n"), F.lit("\nScores:"))


def answer_prompt(query: Column, context: Column) -> Column:
    return F.concat(F.lit("Answer from the context alone; say so if it is not enough.\n\nContext:\n"), context, F.lit("\n\nQuestion: "), query, F.lit("\nAnswer:"))
