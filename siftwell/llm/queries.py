"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm import boilerplate, borda, language, leakage, lookalike, neighbours, packing, residue, scans, splitting
from siftwell.session import cut, table

SCORES = ("vector", "bm25", "graph/entity", "rerank")


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    """One row per query and item with its four scores, higher better; of repeated rows the latest counts."""
    r = table(spark, sf, "retrieval_results").select(
        F.col("query_id").alias("list"), F.col("doc_id").alias("item"), F.col("metadata.retrieval_channel").alias("channel"),
        F.when(F.col("metadata.better") == "lower", -F.col("score")).otherwise(F.col("score")).alias("score"),
        borda.usable(F.col("metadata.rerank_score")).alias("rerank"), "retrieved_at",
    )
    one = r.groupBy("list", "item", "channel").agg(F.max_by("score", "retrieved_at").alias("score"), F.max("rerank").alias("rerank"))
    channels = [F.max(F.when(F.col("channel") == c, F.col("score"))).alias(c) for c in SCORES[:3]]
    return one.groupBy("list", "item").agg(*channels, F.max("rerank").alias("rerank"))


def p1_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, doc_id, points): the whole ranking of every query."""
    return borda.borda(_scores(spark, sf), dict.fromkeys(SCORES, 1.0)).select(F.col("list").alias("query_id"), F.col("item").alias("doc_id"), "points")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    best = borda.top(borda.borda(_scores(spark, sf), dict.fromkeys(SCORES, 1.0)), 3)
    return best.select(F.col("list").alias("query_id"), F.col("item").alias("doc_id"))


P1_SQL = """
WITH r AS (
  SELECT query_id, doc_id, metadata.retrieval_channel AS ch,
         arg_max(CASE WHEN metadata.better = 'lower' THEN -score ELSE score END, retrieved_at) AS s,
         max(CASE WHEN isfinite(metadata.rerank_score) THEN metadata.rerank_score END) AS rr
  FROM retrieval_results GROUP BY ALL),
items AS (SELECT query_id, doc_id, max(rr) AS rr FROM r GROUP BY ALL),
long AS (
  SELECT query_id, doc_id, ch, s FROM r WHERE isfinite(s)
  UNION ALL SELECT query_id, doc_id, 'rerank', rr FROM items WHERE rr IS NOT NULL),
placed AS (
  SELECT *, rank() OVER (PARTITION BY query_id, ch ORDER BY s DESC)
            + (count(*) OVER (PARTITION BY query_id, ch, s) - 1) / 2.0 AS place,
         count(*) OVER (PARTITION BY query_id, ch) AS scored FROM long),
grid AS (
  SELECT i.query_id, i.doc_id, c.ch, count(*) OVER (PARTITION BY i.query_id, c.ch) AS n
  FROM items i CROSS JOIN (VALUES ('vector'), ('bm25'), ('graph/entity'), ('rerank')) c(ch)),
points AS (
  SELECT g.query_id, g.doc_id,
         sum(g.n - coalesce(p.place, (coalesce(m.scored, 0) + 1 + g.n) / 2.0)) AS points
  FROM grid g LEFT JOIN placed p USING (query_id, doc_id, ch)
  LEFT JOIN (SELECT DISTINCT query_id, ch, scored FROM placed) m ON m.query_id = g.query_id AND m.ch = g.ch
  GROUP BY ALL)
"""


def _text_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "content_blocks").where("type = 'text'")


def _boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    return boilerplate.block_occurrences(_text_blocks(spark, sf), "id", "source_file", "doc_id", "content")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return boilerplate.found_lines(_boilerplate(spark, sf)).select(F.col("id").alias("block_id"), "line_no").distinct()


def p2_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """(block_id, content) of every text block without its source's boilerplate blocks."""
    out = boilerplate.remove(_text_blocks(spark, sf), _boilerplate(spark, sf), "id", "content")
    return out.select(F.col("id").alias("block_id"), F.col("text").alias("content"))


def _counts(spark: SparkSession, sf: str) -> dict[str, int]:
    texts = table(spark, sf, "content_blocks").select("content").union(table(spark, sf, "chunks").select("text"))
    return lookalike.member_counts(texts, "content")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    counts = _counts(spark, sf)
    blocks = lookalike.look_alike_pairs(table(spark, sf, "content_blocks"), "id", "content", counts)
    return blocks.unionByName(lookalike.look_alike_pairs(table(spark, sf, "chunks"), "id", "text", counts))


def p3_classes(spark: SparkSession, sf: str) -> DataFrame:
    """(id, spelling, class): one row for every block and chunk whose text reads like another spelling."""
    counts = _counts(spark, sf)
    blocks = lookalike.look_alike_classes(table(spark, sf, "content_blocks"), "id", "content", counts)[1]
    return blocks.unionByName(lookalike.look_alike_classes(table(spark, sf, "chunks"), "id", "text", counts)[1])


def p3_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """(id, text): every block and chunk once, with its text in one form."""
    counts = _counts(spark, sf)
    a = table(spark, sf, "content_blocks").select("id", F.col("content").alias("text"))
    rows = a.union(table(spark, sf, "chunks").select("id", "text")).groupBy("id").agg(F.min("text").alias("text"))
    return rows.select("id", lookalike.canonical(F.col("text"), counts).alias("text"))


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    blocks = _text_blocks(spark, sf)
    model = language.fit(table(spark, sf, "documents"), "doc_id", "text", "lang", blocks)
    return cut(language.segments(blocks, model, "id", "doc_id", "content", "language"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    found = _segments(spark, sf)
    paras = found.where("language is not null and not (language <=> label)").select(F.col("id").alias("item"), "para_no", "language")
    files = table(spark, sf, "parsed_files").select(F.col("id").alias("doc"), language.label_code(F.col("language")).alias("label")).dropDuplicates(["doc"])
    wrong = language.document_languages(found).where("major").join(files, "doc").where("not (language <=> label)")
    return paras.unionByName(wrong.select(F.col("doc").alias("item"), F.lit(-1).cast("long").alias("para_no"), "language"))


def p4_labels(spark: SparkSession, sf: str) -> DataFrame:
    """(item, para_no, language, confidence): every paragraph (from 0) of a text block, and every block of any type and every file (-1).

    What holds no letters has a null language and confidence 0.
    """
    blocks, files = table(spark, sf, "content_blocks"), table(spark, sf, "parsed_files")
    return _labels(blocks, files, language.fit(table(spark, sf, "documents"), "doc_id", "text", "lang", _text_blocks(spark, sf)))


def _labels(blocks: DataFrame, files: DataFrame, model: language.Backoff) -> DataFrame:
    names = ("id", "doc_id", "content", "language")
    texts = language.segments(blocks.where("type = 'text'"), model, *names, every=True).withColumn("is_text", F.lit(True))
    other = language.segments(blocks.where("not (type <=> 'text')"), model, *names, every=True).withColumns({"is_text": F.lit(False), "counts": F.lit(False)})
    found = cut(texts.unionByName(other))
    paras = found.where("is_text").select(F.col("id").alias("item"), "para_no", "language", "confidence")
    items = blocks.select(F.col("id").alias("item")).union(blocks.select("doc_id")).union(files.select("id")).dropna().distinct()
    whole = language.whole_languages(found, "id").union(language.whole_languages(found, "doc"))
    rows = items.join(whole, "item", "left").select("item", F.lit(-1).cast("long").alias("para_no"), "language", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return paras.unionByName(rows)


def p4_keys(spark: SparkSession, sf: str) -> DataFrame:
    """(item, para_no): what p4_labels has a row for."""
    return p4_labels(spark, sf).select("item", "para_no")


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf, "chunks"), "id", "text", ["title", "title_level"])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf).select("id").distinct()


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """(id, piece_no, piece, title, title_level) of every chunk above the limit."""
    return _pieces(spark, sf)


def p5_checked(spark: SparkSession, sf: str) -> DataFrame:
    """(id, fits, rejoined): whether all pieces keep the limit, and how many characters they have without what they share."""
    chars = F.length("piece")
    fits = F.max(splitting.tokens(F.col("piece"))) <= 512
    return _pieces(spark, sf).groupBy("id").agg(fits.alias("fits"), (F.sum(chars) - 256 * (F.count("*") - 1)).alias("rejoined"))


def _containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill(table(spark, sf, "documents"), "doc_id", packing.token_count(F.col("text")))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _containers(spark, sf).where("parts > 1").select(F.col("id").alias("doc_id")).distinct()


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, part, tokens, shard, container): the container of every document or part of one."""
    return _containers(spark, sf).select(F.col("id").alias("doc_id"), "part", "tokens", "shard", "container")


def p8_checked(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, tokens, parts, fits): each document's tokens in all containers, its parts, and whether their containers keep the limit."""
    c = cut(_containers(spark, sf))
    load = c.groupBy("shard", "container").agg(F.sum("tokens").alias("load"))
    per = c.join(load, ["shard", "container"]).groupBy(F.col("id").alias("doc_id"))
    return per.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("parts"), (F.max("load") <= 1024).alias("fits"))


SINGLE_SQL = r"\p{Han}\p{Hangul}\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9F}"
TOKENS_SQL = rf"""len(regexp_extract_all(regexp_replace(text, '([{SINGLE_SQL}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}\p{{M}}]+|[^\s\p{{Z}}\p{{Cc}}\p{{Cf}}\p{{Cs}}]'))"""


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    found = leakage.leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text")
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"))


def _residue(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return residue.residue(docs, residue.fit(docs, "text", "title"), "doc_id", "text", "title")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _residue(spark, sf).select(F.col("id").alias("doc_id"))


def p10_kept(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id): the corpus without residue."""
    docs = table(spark, sf, "documents").select("doc_id").distinct()
    return docs.join(_residue(spark, sf).select(F.col("id").alias("doc_id")), "doc_id", "left_anti")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    near = neighbours.nearest(table(spark, sf, "content_blocks"), "id", "embeddings", 64, k=5, at_least=0.95)
    pair = near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"))
    return pair.distinct()


def p6_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """(id, other, similarity): of every usable vector the five most similar others."""
    return neighbours.nearest(table(spark, sf, "content_blocks"), "id", "embeddings", 64, k=5, relax=neighbours.RELAX_ALL, shard=65_536)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return scans.faults(*scans.tables(spark, sf)).select("item", "line_no", "fault")


def p7_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, para_no, text): the repaired, continuous text of every scanned file."""
    return scans.paragraphs(*scans.tables(spark, sf))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_SQL
        + """SELECT query_id, doc_id FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, doc_id) AS k FROM points) WHERE k <= 3""",
        "p1_ranking": P1_SQL + "SELECT query_id, doc_id, points::DOUBLE AS points FROM points",
        "p5_found": "SELECT DISTINCT id FROM chunks WHERE length(text) // 4 > 512",
        "p6_found": """WITH v AS (SELECT id, embeddings::DOUBLE[] AS e FROM (SELECT DISTINCT ON (id) id, embeddings FROM content_blocks WHERE len(embeddings) = 64)
  WHERE len(list_filter(embeddings, lambda x: isfinite(x))) = 64 AND len(list_filter(embeddings, lambda x: x <> 0)) > 0),
n AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.id <> b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
k AS (SELECT id, other FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, other) <= 5)
SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM k""",
        "p4_keys": r"""WITH b AS (SELECT DISTINCT ON (id) id, doc_id, type, content FROM content_blocks WHERE id IS NOT NULL ORDER BY id)
SELECT id AS item, unnest(range(0, len(regexp_split_to_array(content, '\n[^\S\n]*(?:\n[^\S\n]*)+')))) AS para_no FROM b WHERE type = 'text' AND content IS NOT NULL
UNION ALL SELECT item, -1 FROM (SELECT id AS item FROM b UNION SELECT doc_id FROM content_blocks UNION SELECT id FROM parsed_files) WHERE item IS NOT NULL""",
        "p5_checked": "SELECT DISTINCT id, true AS fits, length(text) AS rejoined FROM chunks WHERE length(text) // 4 > 512",
        "p8_checked": f"SELECT doc_id, n AS tokens, ceil(n / 1024)::BIGINT AS parts, true AS fits FROM (SELECT DISTINCT doc_id, {TOKENS_SQL} AS n FROM documents) WHERE n > 0",
        "p8_found": f"SELECT DISTINCT doc_id FROM documents WHERE {TOKENS_SQL} > 1024",
    }
