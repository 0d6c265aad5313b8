"""Lines repeated across one source's documents.

Lines are nodes and consecutive lines edges of one weighted graph per source; weights are the numbers
of documents that carry them. Nodes and edges of high support are kept, connected components of what
is kept are the boilerplate blocks, and their occurrences are deleted from the texts. As a line of high
support is a component at least by itself, no line that alone is repeated enough stays.
Two lines are the same node if they differ only in letter case, white space, digits, look-alike or
invisible characters, or marks around the line. Rows with a null source, document or text have no
lines and stay as they are; repeated rows count once; sources of few documents have no boilerplate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.lookalike import Disjoint, fold
from siftwell.session import cut, filled

SPACE, DIGITS, ROUND = re.compile(r"\s+"), re.compile(r"\d+"), re.compile(r"^[\W_]+|[\W_]+$")
SALT = 8
OCCURRENCES = "src long, doc long, id string, line_no long, line long, next long"


def line_form(line: str) -> str:
    """What a line is compared by; empty for a line without letters."""
    one = ROUND.sub("", DIGITS.sub("0", SPACE.sub("", fold(line).lower())))
    return one if any(map(str.isalpha, one)) else ""


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def salt(of: str) -> Column:
    return F.pmod(F.col(of), F.lit(SALT)).cast("int").alias("salt")


def occurrences(blocks: DataFrame, ident: str, source: str, doc: str, text: str) -> DataFrame:
    """One row for each lettered line of each row: hashed source, document and line, and the next lettered line's hash."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int | None] = {}
        for b in batches:
            if len(seen) > 200_000:
                seen.clear()
            src, doc, ids, no, line, after = [], [], [], [], [], []
            for i, s, d, t in zip(b["i"], b["s"], b["d"], b["t"], strict=True):
                got = []
                for k, raw in enumerate(t.split("\n")):
                    if raw not in seen:
                        seen[raw] = _hash(f) if (f := line_form(raw)) else None
                    if (h := seen[raw]) is not None:
                        got.append((k, h))
                n = len(got)
                ids += [i] * n
                src += [_hash(s)] * n
                doc += [_hash(d)] * n
                no += [k for k, _ in got]
                line += [h for _, h in got]
                after += [h for _, h in got[1:]] + [None] * (n > 0)
            yield pd.DataFrame({"src": np.array(src, "int64"), "doc": np.array(doc, "int64"), "id": ids, "line_no": np.array(no, "int64"), "line": np.array(line, "int64"), "next": pd.array(after, "Int64")})

    src = blocks.select(F.col(ident).alias("i"), F.col(source).alias("s"), F.col(doc).alias("d"), F.col(text).alias("t")).dropna()
    return src.mapInPandas(filled(part), OCCURRENCES)


def salted(df: DataFrame) -> DataFrame:
    """A row for each salt: joined with salted rows on it too, a key that holds a third of all rows is spread."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def boilerplate(lines: DataFrame, share: float = 0.15, least: int = 5) -> DataFrame:
    """(src, line, block, docs): the kept lines of each source and the boilerplate block each belongs to.

    A line is kept if it stands in at least `least` documents and `share` of the source's documents,
    an edge likewise. Blocks are the connected components of kept lines and edges, so every kept line is
    in one, if alone. A source's kept lines are at most its mean number of lines a document divided by
    `share`, however large it is, so one task can join them.
    """
    per = lines.select("src", "doc").distinct().groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    enough = (F.col("docs") >= least) & (F.col("docs") >= F.lit(share) * F.col("n"))
    nodes = lines.select("src", "line", "doc").distinct().groupBy("src", "line").agg(F.count("*").alias("docs"))
    nodes = nodes.where(F.col("docs") >= least).join(per, "src").where(enough)
    kept = salted(nodes.select("src", "line"))
    pairs = lines.where("next is not null").select("src", "line", "next", "doc", salt("doc")).join(kept, ["src", "line", "salt"], "left_semi")
    pairs = pairs.join(kept.withColumnRenamed("line", "next"), ["src", "next", "salt"], "left_semi").select("src", "line", "next", "doc").distinct()
    edges = pairs.groupBy("src", "line", "next").agg(F.count("*").alias("docs")).join(per, "src").where(enough)
    graph = nodes.select("src", "line", F.col("line").alias("next"), "docs", F.lit(True).alias("node")).unionByName(edges.select("src", "line", "next", "docs", F.lit(False).alias("node")))

    def parts(g: pd.DataFrame) -> pd.DataFrame:
        sets = Disjoint()
        for a, b in zip(g["line"], g["next"], strict=True):
            sets.join(str(a), str(b))
        own = g[g["node"]]
        return pd.DataFrame({"src": own["src"], "line": own["line"], "block": [int(sets.find(str(a))) for a in own["line"]], "docs": own["docs"]})

    return graph.groupBy("src").applyInPandas(parts, "src long, line long, block long, docs long")


def block_occurrences(blocks: DataFrame, ident: str, source: str, doc: str, text: str, share: float = 0.15, least: int = 5) -> DataFrame:
    """(id, block, lines): where each boilerplate block stands in each row of the input, by sorted line numbers; rows count once by their id."""
    lines = cut(occurrences(blocks, ident, source, doc, text))
    kept = salted(boilerplate(lines, share, least).select("src", "line", "block"))
    at = lines.select("src", "line", "id", "line_no", salt("doc")).join(kept, ["src", "line", "salt"])
    return at.groupBy("id", "block").agg(F.array_sort(F.collect_set("line_no")).alias("lines"))


def found_lines(occurred: DataFrame) -> DataFrame:
    """(id, line_no, block): the lines of block occurrences."""
    return occurred.select("id", F.explode("lines").alias("line_no"), "block")


def remove(blocks: DataFrame, occurred: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, text) of every row with the blocks' occurrences taken out, all else kept; repeated ids come out once."""
    gone = occurred.groupBy("id").agg(F.flatten(F.collect_list("lines")).alias("gone"))
    rows = blocks.select(F.col(ident).alias("id"), F.col(text).alias("text")).dropDuplicates(["id"]).join(gone, "id", "left")
    kept = F.filter(F.split("text", "\n", -1), lambda _, k: ~F.array_contains("gone", k.cast("long")))
    return rows.select("id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
