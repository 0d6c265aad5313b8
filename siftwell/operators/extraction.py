"""Entities and relationships from model replies: line parsers, merges, and the pipeline around a provider."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.session import cut

# The reply format.
FIELD, DONE = "<|#|>", "<|COMPLETE|>"
SPLIT = r"<\|#\|>"
MIN_CONTENT = 10
SUMMARY_BATCH, SUMMARY_MOST = 3, 10


def _lines(replies: DataFrame, block: str, reply: str, starts: str) -> DataFrame:
    """The lines of each reply that begin with a word, up to the line that says the reply is complete."""
    lines = F.split(F.trim(F.col(reply)), "\n")
    until = F.array_position(F.transform(lines, lambda s: s.contains(DONE)), True)
    kept = F.when(until > 0, F.slice(lines, F.lit(1), (until - 1).cast("int"))).otherwise(lines)
    rows = replies.select(F.col(block).alias("block_id"), F.posexplode(kept).alias("pos", "raw")).select("block_id", "pos", F.trim("raw").alias("line"))
    return rows.where(F.col("line").startswith(starts))


def _field(n: int) -> Column:
    return F.trim(F.try_element_at(F.split("line", SPLIT), F.lit(n)))


def entities(replies: DataFrame, block: str = "block_id", reply: str = "response") -> DataFrame:
    """(block_id, pos, entity_name, entity_type, description); lines that lack a field are left out. The older <|a|> form is read too."""
    rows = _lines(replies, block, reply, "entity")
    old = r"^entity<\|([^|]+)\|><\|([^|]+)\|><\|([^|]+)\|>"
    new = F.col("line").contains(FIELD) & (_field(1) == "entity")
    pick = lambda n: F.when(new, _field(n + 1)).when(~F.col("line").contains(FIELD), F.trim(F.regexp_extract("line", old, n)))
    out = rows.select("block_id", "pos", pick(1).alias("entity_name"), pick(2).alias("entity_type"), pick(3).alias("description"))
    return out.where("entity_name <> '' and entity_type <> '' and description <> ''")


def relationships(replies: DataFrame, block: str = "block_id", reply: str = "response") -> DataFrame:
    """(block_id, pos, src_id, tgt_id, keywords, description, weight); a sixth field that is no number counts 1."""
    rows = _lines(replies, block, reply, "relation").where(F.size(F.split("line", SPLIT)) >= 5)
    out = rows.select("block_id", "pos", _field(2).alias("src_id"), _field(3).alias("tgt_id"), _field(4).alias("keywords"), _field(5).alias("description"), F.coalesce(_field(6).try_cast("double"), F.lit(1.0)).alias("weight"))
    return out.where("src_id <> '' and tgt_id <> ''")


def _joined(value: str, order: list[str]) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("v"))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), "; ")


def merge_entities(rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per lower-case name: the first row's name and type, descriptions in order, the number merged."""
    order = order or ["block_id", "pos"]
    first = F.min_by(F.struct("entity_name", "entity_type"), F.struct(*order))
    got = rows.groupBy(F.lower("entity_name").alias("name_key")).agg(first.alias("f"), _joined("description", order).alias("description"), F.count("*").alias("merged"))
    return got.select("name_key", F.col("f.entity_name").alias("entity_name"), F.col("f.entity_type").alias("entity_type"), "description", "merged")


def merge_relationships(rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per directed pair: greatest weight, descriptions in order, sorted set of keywords."""
    order = order or ["block_id", "pos"]
    words = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.array_join(F.collect_list("keywords"), ","), ","), lambda w: F.trim(w)), lambda w: w != "")))
    return rows.groupBy(F.lower("src_id").alias("src"), F.lower("tgt_id").alias("dst")).agg(F.max("weight").alias("weight"), _joined("description", order).alias("description"), F.array_join(words, ", ").alias("keywords"))


def upsert(rows: DataFrame, longest: bool = False) -> DataFrame:
    """One row per name: the last one, or the one of the longest description, the earlier of equal ones."""
    by = F.struct(F.length("description"), -F.col("pos")) if longest else F.col("pos")
    got = rows.groupBy(F.lower("entity_name").alias("name_key")).agg(F.max_by(F.struct("entity_name", "entity_type", "description"), by).alias("e"))
    return got.select("name_key", "e.*")


def summarize(groups: DataFrame, descriptions: str, summary: Callable[[list[str]], str] | None = None) -> DataFrame:
    """A column `summary` of an array of descriptions: batches are summarised until few are left; joined by '; ' without a provider."""

    def levels(items: list[str]) -> str:
        items = [x for x in items if x]
        while len(items) > SUMMARY_MOST:
            items = [one(items[i : i + SUMMARY_BATCH]) for i in range(0, len(items), SUMMARY_BATCH)]
        return one(items)

    def one(items: list[str]) -> str:
        if len(items) < 2 or summary is None:
            return "; ".join(items)
        try:
            return summary(items)
        except Exception:
            return "; ".join(items)

    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda x: levels(list(x)) if x is not None else None)

    return groups.withColumn("summary", run(F.col(descriptions)))


def replies(blocks: DataFrame, provider: Callable[[str], str], block: str = "id", content: str = "content") -> DataFrame:
    """(block_id, response): one call for each block of enough text, in Arrow batches; a failed call gives a null reply.

    The replies are written to the shared folder: what is read from them, or lost with an executor, asks no model twice.
    """

    def safe(text: str) -> str | None:
        try:
            return provider(text)
        except Exception:
            return None

    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        return col.map(safe, na_action="ignore")

    some = blocks.where(F.length(F.trim(F.col(content))) >= MIN_CONTENT)
    return cut(some.select(F.col(block).alias("block_id"), run(F.col(content)).alias("response")))


def _names(rows: DataFrame, most: int | None = None) -> DataFrame:
    """(block_id, names) of the entities found in each block, sorted; the first `most` of them."""
    names = F.array_sort(F.collect_set("entity_name"))
    return rows.groupBy("block_id").agg((names if most is None else F.slice(names, 1, most)).alias("names"))


def glean(blocks: DataFrame, found: DataFrame, provider: Callable[[str], str], block: str = "id", content: str = "content") -> DataFrame:
    """Another round of extraction, told what each block has given so far: of a name's rows the one of the longest description stays, the earlier of equal ones."""
    asked = blocks.join(_names(found), F.col(block) == F.col("block_id"), "left")
    prompt = F.concat(F.lit("Found so far: "), F.coalesce(F.array_join("names", ", "), F.lit("")), F.lit(". List what is missing, and better descriptions.\n"), F.col(content))
    more = entities(replies(asked.withColumn("_prompt", F.when(F.length(F.trim(F.col(content))) >= MIN_CONTENT, prompt)), provider, block, "_prompt"))
    every = found.withColumn("round", F.lit(0)).unionByName(more.withColumn("round", F.lit(1)))
    first = Window.partitionBy(F.lower("entity_name")).orderBy(F.desc(F.length("description")), "round", "block_id", "pos")
    kept = every.select("*", F.row_number().over(first).alias("k"), F.max("round").over(Window.partitionBy(F.lower("entity_name"))).alias("again"))
    return kept.where((F.col("k") == 1) | ((F.col("again") == 0) & (F.col("round") == 0))).drop("k", "again", "round")


def relations_among(blocks: DataFrame, found: DataFrame, provider: Callable[[str], str], most: int = 30, block: str = "id", content: str = "content") -> DataFrame:
    """Relationships that a model finds among the entities given: blocks of fewer than two are not asked, of many the first `most` by name are named."""
    asked = blocks.join(_names(found, most).where(F.size("names") >= 2), F.col(block) == F.col("block_id"))
    prompt = F.concat(F.lit("Entities: "), F.array_join("names", ", "), F.lit(". List the relations among them.\n"), F.col(content))
    return relationships(replies(asked.withColumn("_prompt", prompt), provider, block, "_prompt"))


def extract(blocks: DataFrame, provider: Callable[[str], str], rounds: int = 0, block: str = "id", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of blocks, each reply parsed for both; another round, one at most, gleans entities."""
    got = replies(blocks, provider, block, content)
    found = entities(got)
    return (glean(blocks, found, provider, block, content) if rounds > 0 else found), relationships(got)


def build_graph(blocks: DataFrame, provider: Callable[[str], str], rounds: int = 0) -> tuple[DataFrame, DataFrame]:
    """Merged entities of blocks, and the merged relationships that the first replies name or that are found among each block's entities."""
    e, r = extract(blocks, provider, rounds)
    among = relations_among(blocks, e, provider)
    every = r.unionByName(among.withColumn("pos", F.col("pos") + 1_000_000)).groupBy("block_id", "src_id", "tgt_id", "description")
    every = every.agg(F.min("pos").alias("pos"), F.array_join(F.array_sort(F.collect_set("keywords")), ",").alias("keywords"), F.max("weight").alias("weight"))
    return merge_entities(e), merge_relationships(every)


def entity_names(replies: DataFrame, key: str = "query_id", reply: str = "response") -> DataFrame:
    """(key, name) of replies in the JSON form {"entities": [...]}; another reply names none."""
    names = F.from_json(F.col(reply), "entities array<string>")["entities"]
    return replies.select(key, F.explode(names).alias("name"))


def query_entities(queries: DataFrame, provider: Callable[[str], str], vertices: DataFrame) -> DataFrame:
    """Vertices that a model names for queries (query_id, text), by the line format."""
    got = replies(queries, provider, "query_id", "text")
    named = entities(got).select(F.lower("entity_name").alias("id")).distinct()
    return vertices.join(named, "id", "left_semi")
