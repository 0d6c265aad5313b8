"""BM25 as tables: postings, document lengths, term statistics; exact top-k for any number of queries.

Texts are read and split once: an index is the table of counts (document, term, times), merged map-side
before its shuffle and written to the shared folder, and everything else is taken from that. A search
packs the postings of its queries' terms into blocks of documents and scores a query against a block in
arrays, so that pairs of a query and a document are never rows: a task holds the k-th best score of every
query and hands on what reaches it. `search_texts` packs them from the texts, without an index. Documents
without a positive score follow by id only for queries of which fewer than k have one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.scores import saturate
from siftwell.functions.text import WORD, tokens
from siftwell.operators.retrieval import in_blocks
from siftwell.session import cut

K1, B = 1.5, 0.75
QUERIES = 1 << 15  # at once: their terms go to every task
BLOCK = 4096  # documents whose scores are one array
BLOCKS = 8  # a task
TOGETHER = 64  # lists of terms scored at once: their scores of a block are 2 MB
DENSE = 8  # a term of at least 1/8 of a block's documents is an array of all of them


@dataclass
class Index:
    postings: DataFrame  # doc, term, tf
    lengths: DataFrame  # doc, len
    terms: DataFrame  # term, df, idf
    corpus: DataFrame  # n, avgdl: one row

    def save(self, path: str) -> None:
        for name in ("postings", "lengths", "terms", "corpus"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "terms", "corpus")))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avgdl"))


def term_stats(postings: DataFrame, corpus: DataFrame) -> DataFrame:
    """Document frequencies and idf, which is negative for terms of more than half of the documents."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(corpus.select("n"))).select("term", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def words(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, words); null texts have none."""
    return docs.select(F.col(doc).alias("doc"), F.coalesce(tokens(F.col(text)), F.array()).alias("words"))


def build(docs: DataFrame, doc: str, text: str) -> Index:
    """Index a table of documents; null texts have no terms and length 0."""
    each = words(docs, doc, text).select("doc", F.explode_outer("words").alias("term"))
    counts = cut(each.groupBy("doc", "term").agg(F.count("term").alias("tf")))
    postings = counts.where("term is not null")
    lengths = counts.groupBy("doc").agg(F.sum("tf").cast("int").alias("len"))
    corpus = corpus_stats(lengths)
    return Index(postings, lengths, term_stats(postings, corpus), corpus)


def split_words(lower: pa.Array) -> pa.ListArray:
    """The words of texts in lower case; null texts have none. Letters are those of Arrow's and DuckDB's Unicode, newer than Java's in `tokens`."""
    each = pc.split_pattern(pc.replace_substring_regex(lower.cast(pa.large_string()).fill_null(""), f"[^{WORD[1:]}", " "), " ")
    words = each.flatten()
    keep = pc.greater_equal(pc.utf8_length(words), 2)
    ends = np.cumsum(np.concatenate([[0], keep.to_numpy(zero_copy_only=False)]))[each.offsets.to_numpy() - each.offsets[0].as_py()]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.filter(keep).cast(pa.string()))


@dataclass
class Asked:
    """A block of queries: those of `ids`, whose terms stand one after another, a term as often as its query has it."""

    ids: pa.Array
    ends: np.ndarray  # of each query's terms
    terms: np.ndarray  # places in vocabulary
    vocabulary: pa.Array

    @classmethod
    def of(cls, queries: DataFrame) -> Asked:
        got = queries.groupBy("query_id").agg(F.flatten(F.collect_list(F.coalesce(tokens(F.col("text")), F.array()))).alias("terms")).toArrow()
        return cls.by(got["query_id"].combine_chunks(), got["terms"].combine_chunks())

    @classmethod
    def of_texts(cls, queries: DataFrame) -> Asked:
        """With words as `split_words` gives them."""
        got = queries.groupBy("query_id").agg(F.concat_ws(" ", F.collect_list(F.lower("text"))).alias("text")).toArrow()
        return cls.by(got["query_id"].combine_chunks(), split_words(got["text"].combine_chunks()))

    @classmethod
    def by(cls, ids: pa.Array, terms: pa.ListArray) -> Asked:
        every = pc.dictionary_encode(terms.flatten())
        return cls(ids, np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False)), every.indices.to_numpy(), every.dictionary)


def _packed(docs: pa.Array, lens: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of documents in the order of their ids, nulls last, and their postings by term; row ascends."""
    whole = lambda x: pa.array([x.astype(np.int32).tobytes()], pa.binary())
    each = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    for a in range(0, len(docs), BLOCK):
        part = docs.slice(a, BLOCK)
        order = pc.sort_indices(part)
        place = np.empty(len(part), np.int64)
        place[order.to_numpy()] = np.arange(len(part))
        lo, hi = np.searchsorted(row, (a, a + len(part)))
        at, ids = place[row[lo:hi] - a], term[lo:hi]
        by = np.lexsort((at, ids))
        seen, df = np.unique(ids, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [each(part.take(order)), pa.array([int(lens[a : a + len(part)].sum())]), whole(lens[a : a + len(part)][order.to_numpy()]), each(pa.array(seen.astype(np.int32))), each(pa.array(df.astype(np.int32))), whole(at[by]), whole(tf[lo:hi][by])],
            ["docs", "words", "lens", "seen", "df", "at", "tf"],
        )


def _pack_words(vocabulary: pa.Array) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (doc, words)."""

    def run(batches):
        for b in batches:
            each = b.column(1)
            lens = pc.list_value_length(each).to_numpy(zero_copy_only=False).astype(np.int64)
            found = pc.index_in(each.flatten(), value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lens)), lens)[found >= 0]
            key, tf = np.unique(row * max(len(vocabulary), 1) + found[found >= 0], return_counts=True)
            yield from _packed(b.column(0), lens, key // max(len(vocabulary), 1), key % max(len(vocabulary), 1), tf)

    return run


def _pack_texts(vocabulary: pa.Array) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (doc, text in lower case)."""

    def run(batches):
        parts = (b.slice(a, BLOCK) for b in batches for a in range(0, b.num_rows, BLOCK))
        yield from _pack_words(vocabulary)(pa.RecordBatch.from_arrays([b.column(0), split_words(b.column(1))], ["doc", "words"]) for b in parts)

    return run


def _pack_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc, len, postings of structs of id and tf)."""
    for b in batches:
        n, posts = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False), b.column(2).flatten()
        yield from _packed(b.column(0), b.column(1).to_numpy(), np.repeat(np.arange(len(n)), n), posts.field(0).to_numpy(), posts.field(1).to_numpy())


def _best(asked: Asked, idf: np.ndarray, avgdl: float, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(query_id, doc, score) from blocks of documents: at least the first k of each query among a task's, ties by document; no score of 0."""
    n_terms = np.diff(asked.ends, prepend=0)
    of = np.repeat(np.arange(len(n_terms)), n_terms)

    def run(batches):
        floor, kept = np.zeros((len(n_terms), k)), []  # the k best scores of each query, rounded; the least of them is first
        for b in batches:
            for i in range(b.num_rows):
                docs = b.column(0)[i].values
                lens, at, tf = (np.frombuffer(b.column(j)[i].as_py(), np.int32) for j in (2, 5, 6))
                seen, df = (b.column(j)[i].values.to_numpy() for j in (3, 4))
                if not len(seen) or docs.null_count == len(docs):
                    continue
                w = np.repeat(idf[seen], df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[at] / avgdl))
                start = np.cumsum(df) - df
                slot = np.full(len(idf), -1)
                slot[seen] = np.arange(len(seen))
                row, slots, first, kind = _lists(slot[asked.terms], of, len(floor))
                # No document of the block can have more than the sum of its terms' greatest parts.
                peak = np.maximum(np.maximum.reduceat(w, start), 0.0)[slots]
                most, low = np.bincount(row, weights=peak, minlength=len(first)), np.full(len(first), np.inf)
                np.minimum.at(low, kind, floor[:, 0])
                many = np.flatnonzero(df * DENSE >= len(docs))
                rows, dense = np.zeros((len(many), len(docs))), np.full(len(seen), -1)
                for r, t in enumerate(many.tolist()):
                    rows[r, at[start[t] : start[t] + df[t]]] = w[start[t] : start[t] + df[t]]
                    dense[t] = r
                able = np.flatnonzero((most > 0) & (most > low - 1e-9))
                if not len(able):
                    continue
                number = np.full(len(first), -1)
                number[able] = np.arange(len(able))
                row, slots = number[row][number[row] >= 0], slots[number[row] >= 0]
                got = []
                for a in range(0, len(able), TOGETHER):
                    part, n = slice(*np.searchsorted(row, (a, a + TOGETHER))), min(TOGETHER, len(able) - a)
                    total = _scores(row[part] - a, slots[part], n, len(docs), (at, w, start, df), rows, dense)
                    hit = _hits(total[:, : len(docs) - docs.null_count], low[able[a : a + n]], k)
                    got.append((hit[0] + a, *hit[1:]))
                row, hit, place, score, rounded = map(np.concatenate, zip(*got, strict=True))
                new = np.zeros((len(able), k))
                new[row, place] = rounded
                q = np.flatnonzero(number[kind] >= 0)
                its = number[kind[q]]
                floor[q] = np.sort(np.concatenate([floor[q], new[its]], 1), 1)[:, -k:]
                n = np.bincount(row, minlength=len(able))
                each = np.repeat((np.cumsum(n) - n)[its] - np.cumsum(n[its]) + n[its], n[its]) + np.arange(n[its].sum())
                q = np.repeat(q, n[its])
                each, q = each[rounded[each] >= floor[q, 0]], q[rounded[each] >= floor[q, 0]]
                kept.append((q, docs.take(pa.array(hit[each])), rounded[each], score[each]))
        for q, docs, rounded, score in kept:
            last = rounded >= floor[q, 0]
            yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(q[last])), docs.filter(pa.array(last)), pa.array(score[last])], ["query_id", "doc", "score"])

    return run


def _lists(slots: np.ndarray, of: np.ndarray, n_queries: int) -> tuple[np.ndarray, ...]:
    """(row, slot) of the different lists of a block's terms that queries have, a query of each list, and each query's list."""
    of, slots = of[slots >= 0], slots[slots >= 0].astype(np.int32)
    slots = slots[np.lexsort((slots, of))]
    n = np.bincount(of, minlength=n_queries)
    ends, raw, lists, kind = (4 * np.cumsum(n)).tolist(), slots.tobytes(), {}, []
    for a, z in zip([0, *ends], ends, strict=False):
        kind.append(lists.setdefault(raw[a:z], len(lists)))
    kind = np.array(kind, np.int64)
    first = np.unique(kind, return_index=True)[1]
    mine = first[kind[of]] == of
    return kind[of[mine]], slots[mine], first, kind


def _scores(row: np.ndarray, slots: np.ndarray, n_lists: int, n_docs: int, posts: tuple, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """A block's scores, lists of terms by documents: rare terms by their postings, all at once, then frequent terms as rows."""
    at, w, start, df = posts
    full = dense[slots]
    few, its = slots[full < 0], row[full < 0]
    n = df[few]
    each = np.repeat(start[few] - np.cumsum(n) + n, n) + np.arange(n.sum())
    total = np.bincount(np.repeat(its * n_docs, n) + at[each], weights=w[each], minlength=n_lists * n_docs).astype(float, copy=False).reshape(n_lists, n_docs)
    for r, t in zip(row[full >= 0].tolist(), full[full >= 0].tolist(), strict=True):
        total[r] += rows[t]
    return total


def _hits(total: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(row, document, place, score, rounded) of each row's first k that reach its low; of those that tie for the last places the first documents."""
    least = np.maximum(low - 1e-9, 1e-300)
    mask = total >= least[:, None]
    width = total.shape[1] // (4 * k)
    if width > 1 and np.count_nonzero(mask) > 4 * k * len(total):
        # The k-th greatest of the maxima of more than k stretches is no greater than the k-th best.
        tops = np.maximum.reduceat(total, np.arange(0, total.shape[1], width), axis=1)
        mask = total >= np.maximum(least, np.partition(tops, -k, axis=1)[:, -k] - 1e-9)[:, None]
    row, hit = np.divmod(np.flatnonzero(mask), total.shape[1])
    score = total[row, hit]
    rounded = np.round(score, 9)
    by = np.lexsort((hit, -rounded, row))
    row, hit, score, rounded = row[by], hit[by], score[by], rounded[by]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    first = place < k
    return row[first], hit[first], place[first], score[first], rounded[first]


PACKED = "docs array<{}>, words long, lens binary, seen array<int>, df array<int>, at binary, tf binary"


def _first(blocks: DataFrame, asked: Asked, corpus: tuple[int, float], queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc, score) of packed blocks: the first k with a positive score of each query."""
    kind = queries.schema["query_id"].dataType.simpleString()
    counts = blocks.select(F.explode(F.arrays_zip("seen", "df")).alias("x")).groupBy("x.seen").agg(F.sum("x.df").alias("df")).toPandas()
    df = np.zeros(len(asked.vocabulary))
    df[counts["seen"].to_numpy(np.int64)] = counts["df"]
    n, avgdl = corpus
    run = _best(asked, np.log((n - df + 0.5) / (df + 0.5)), avgdl, k)
    doc = blocks.schema["docs"].dataType.elementType.simpleString()
    every = blocks.repartition(max(1, -(-blocks.count() // BLOCKS))).mapInArrow(run, f"query_id {kind}, doc {doc}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc")
    return cut(every.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k).drop("rank"))


def _filled(best: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, doc, score, rank) from the documents with a score; the k least ids follow with score 0 where too few have one."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc")
    few = queries.select("query_id").distinct().join(best.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < k)
    rest = docs.orderBy("doc").limit(2 * k)  # 2k ids suffice to skip those ranked
    filler = few.select("query_id").crossJoin(F.broadcast(rest)).join(best.select("query_id", "doc"), ["query_id", "doc"], "left_anti")
    every = best.unionByName(filler.select("query_id", "doc", F.lit(0.0).alias("score")))
    return every.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc, score, rank): the first k documents of each query, ties by id after rounding to 9 places.

    A term that a query repeats counts as often; negative sums count 0.
    """
    spark, doc = queries.sparkSession, index.lengths.schema["doc"].dataType.simpleString()
    corpus = index.corpus.first()

    def run(q: DataFrame) -> DataFrame:
        asked = Asked.of(q)
        ids = spark.createDataFrame(pd.DataFrame({"term": asked.vocabulary.to_pandas(), "id": range(len(asked.vocabulary))}), "term string, id int")
        posts = index.postings.join(ids, "term").groupBy("doc").agg(F.collect_list(F.struct("id", F.col("tf").cast("int").alias("tf"))).alias("postings"))
        rows = index.lengths.join(posts, "doc").select("doc", "len", "postings")
        return _first(cut(rows.mapInArrow(_pack_postings, PACKED.format(doc))), asked, (corpus.n, corpus.avgdl), q, k)

    return _filled(in_blocks(queries, run, QUERIES), queries, index.lengths.select("doc"), k)


def search_texts(docs: DataFrame, doc: str, text: str, queries: DataFrame, k: int) -> DataFrame:
    """`search` of texts without an index: they are split once for each block of queries and no word is shuffled."""
    if docs.groupBy(doc).count().where("count > 1").limit(1).count():
        return search(build(docs, doc, text), queries, k)  # rows of one id are one document
    rows = docs.select(F.col(doc).alias("doc"), F.lower(F.col(text)).alias("text"))

    def run(q: DataFrame) -> DataFrame:
        asked = Asked.of_texts(q)
        blocks = cut(rows.mapInArrow(_pack_texts(asked.vocabulary), PACKED.format(docs.schema[doc].dataType.simpleString())))
        corpus = blocks.agg(F.sum(F.size("docs")).alias("n"), F.sum("words").alias("words")).first()
        return _first(blocks, asked, (corpus.n or 0, (corpus.words or 0) / (corpus.n or 1)), q, k)

    return _filled(in_blocks(queries, run, QUERIES), queries, docs.select(F.col(doc).alias("doc")), k)


def saturated(found: DataFrame) -> DataFrame:
    """Scores in [0, 1], the raw ones kept."""
    return found.withColumn("raw_score", F.col("score")).withColumn("score", saturate(F.col("score")))
