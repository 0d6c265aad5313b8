"""Evaluation texts leaking into training text: a prefix-filtered set join.

A document holds a passage if some run of at least `least` successive words of the item (characters
for scripts without spaces) stands in it with at most one in ten changed. Such a run has a number of
shingles in common with the item within the length of a least run, so at least one of that run's
rarest shingles, its prefix, is among them.

One pass over the documents counts the items' shingles and keeps, of each document, the windows in
which enough of them stand close together, an item's length around; what may be an item's shingle is
told by a bit filter of bounded size. Prefixes are chosen by the counts over all documents and joined
with the windows' shingles; what they give, item and offset, is bounded by length and verified word by
word. Neither items nor documents are collected, and any number of items takes the one pass.

Case, punctuation, spacing, markup and look-alike or invisible characters don't matter. A first line
that several items begin with is an instruction and not part of them. Null texts and items leak
nothing; repeated rows count once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.lookalike import fold
from siftwell.session import cut, filled

TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,80}>")
MARKS = re.compile(r"[^\w\s]+|_+")
ASCII_MARKS = bytes(k for k in range(33, 127) if not chr(k).isalnum())
NOTHING = re.compile(r"[\W_]+")
DENSE = re.compile(r"[぀-ヿ㐀-鿿]")
BASE = np.uint64(0x9E3779B97F4A7C15)
PROBES = 4
BITS_A_KEY, MOST_BITS = 64, 27
SALT = 8
SCANNED = "key long, n long, id long, unit int, first long, ids binary, at array<int>, keys array<long>"


@dataclass(frozen=True)
class Unit:
    """How texts of one kind are compared: the least run, the shingle width, one change in so many."""

    least: int
    width: int
    tolerance: int = 10

    @property
    def span(self) -> int:
        """Shingles of a run of the least length."""
        return self.least - self.width + 1

    @property
    def shared(self) -> int:
        """Shingles that a run of the least length keeps when it is changed as much as is allowed."""
        return self.span - self.width * (self.least // self.tolerance)

    @property
    def prefix(self) -> int:
        """Of a least run's shingles, the rarest so many; those shared can't all be others."""
        return self.span - self.shared + 1


WORDS, CHARACTERS = Unit(20, 5), Unit(30, 7)
UNITS = (WORDS, CHARACTERS)


def words(text: str) -> list[str]:
    t = fold(text).lower()
    if "<" in t:
        t = TAG.sub("", t)
    t = t.encode().translate(None, ASCII_MARKS).decode() if t.isascii() else MARKS.sub("", t)
    return t.split()


def characters(text: str) -> str:
    return NOTHING.sub("", fold(text).lower())


class Numbers:
    """Texts as 32-bit numbers, of words by hash and of characters by code point."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def __call__(self, unit: int, text: str) -> np.ndarray:
        if unit:
            return np.frombuffer(characters(text).encode("utf-32-le", "surrogatepass"), "<u4")
        seen, own = self.seen, words(text)
        if len(seen) > 1_000_000:
            seen.clear()
        return np.array([n if (n := seen.get(w)) is not None else seen.setdefault(w, xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass"))) for w in own], "<u4")


def unit_of(text: str) -> int:
    """The kind an item is compared by: 1, characters, if most of it is of scripts without spaces."""
    return int(len(DENSE.findall(text)) * 2 > len(characters(text)))


def shingle_keys(unit: int, ids: np.ndarray) -> np.ndarray:
    """A key for each window of the unit's width."""
    width = UNITS[unit].width
    n = max(0, len(ids) - width + 1)
    key = np.full(n, unit, "uint64")
    for k in range(width):
        key = (key ^ (key >> np.uint64(29))) * BASE + ids[k : n + k].astype("uint64")
    return key ^ (key >> np.uint64(32))


class Filter:
    """Bits of keys: a key that was put in always passes, another seldom; one that is too full costs time only."""

    def __init__(self, bits: int, slots: np.ndarray) -> None:
        self.bits, self.slots = bits, slots

    @staticmethod
    def place(keys: np.ndarray, bits: int, probe: int) -> np.ndarray:
        odd = np.uint64((2 * int(BASE) * probe + 0xD6E8FEB86659FD93) % (1 << 64))
        return (keys * odd) >> np.uint64(64 - bits)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Where keys pass."""
        at = np.arange(len(keys))
        for k in range(PROBES):
            place = self.place(keys[at], self.bits, k)
            at = at[(self.slots[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
        return at


def numbered(items: DataFrame, item: str, passage: str, often: int = 3) -> DataFrame:
    """(item, unit, ids): every item as numbers, without its first line if at least `often` items begin with that."""
    rows = items.select(F.col(item).cast("long").alias("item"), F.col(passage).alias("t")).dropna().groupBy("item").agg(F.min("t").alias("t"))
    rows = rows.withColumn("line", F.when(F.col("t").contains("\n"), F.substring_index("t", "\n", 1)))
    common = rows.dropna(subset=["line"]).groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= often)
    rest = F.expr("substring(t, length(line) + 2)")
    rows = rows.join(common, "line", "left").select("item", F.when(F.col("n").isNotNull(), rest).otherwise(F.col("t")).alias("t"))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = Numbers()
        for b in batches:
            unit = [unit_of(t) for t in b["t"]]
            yield pd.DataFrame({"item": b["item"], "unit": unit, "ids": [number(u, t).tobytes() for u, t in zip(unit, b["t"], strict=True)]})

    return rows.mapInPandas(filled(part), "item long, unit int, ids binary")


def item_keys(items: DataFrame) -> DataFrame:
    """(item, unit, pos, key) of every shingle of numbered items."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, u, ids in zip(b["item"], b["unit"], b["ids"], strict=True):
                k = shingle_keys(u, np.frombuffer(ids, "<u4"))
                yield pd.DataFrame({"item": i, "unit": u, "pos": np.arange(len(k), dtype="int32"), "key": k.view("int64")})

    return items.mapInPandas(filled(part), "item long, unit int, pos int, key long")


def bit_filter(keys: DataFrame) -> Filter:
    """A filter of all keys: bits are merged before they come to the driver, 2 ** MOST_BITS of them at most."""
    n = max(1, keys.count())
    bits = min(MOST_BITS, max(12, math.ceil(math.log2(n * BITS_A_KEY))))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            place = np.concatenate([Filter.place(b["key"].to_numpy("int64").view("uint64"), bits, k) for k in range(PROBES)])
            yield pd.DataFrame({"slot": (place >> np.uint64(6)).astype("int64"), "mask": (np.uint64(1) << (place & np.uint64(63))).view("int64")})

    got = keys.select("key").mapInPandas(filled(part), "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    slots = np.zeros(1 << (bits - 6), "uint64")
    slots[got["slot"].to_numpy("int64")] = got["mask"].to_numpy("int64").view("uint64")
    return Filter(bits, slots)


def close_together(at: np.ndarray, owner: np.ndarray, unit: Unit) -> np.ndarray:
    """Which hits stand among as many as a run shares, within a least run's length in one document."""
    m = unit.shared - 1
    out = np.zeros(len(at), bool)
    first = np.flatnonzero((at[m:] - at[: len(at) - m] < unit.span) & (owner[m:] == owner[: len(at) - m]))
    for k in range(unit.shared):
        out[first + k] = True
    return out


def scan(docs: DataFrame, ident: str, text: str, may: Filter, longest: int) -> DataFrame:
    """Two kinds of rows in one pass: (key, n), documents that hold a key, and (id, unit, first, ids, at, keys), windows of documents.

    A window holds shingles of items close together, and `longest` numbers around them; at and keys are its hits.
    """
    shared = docs.sparkSession.sparkContext.broadcast((may.bits, may.slots))

    def counts(got: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, "uint64"), np.zeros(0, "int64"))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        may, number = Filter(*shared.value), Numbers()
        seen: list[np.ndarray] = []
        for b in batches:
            names = b["id"].to_numpy()
            for u, unit in enumerate(UNITS):
                texts = [(k, number(u, t)) for k, t in enumerate(b["t"]) if not u or DENSE.search(t)]
                if not texts:
                    continue
                ids = np.concatenate([x for _, x in texts])
                starts = np.cumsum([0, *[len(x) for _, x in texts]])
                owner = np.repeat(np.arange(len(texts)), np.diff(starts))
                keys = shingle_keys(u, ids)
                hit = may(keys)
                hit = hit[owner[hit] == owner[hit + unit.width - 1]]  # no shingle crosses two texts
                own = owner[hit]
                order = np.lexsort((keys[hit], own))
                k, o = keys[hit][order], own[order]
                seen.append(k[np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])] if len(k) else k)
                near = close_together(hit, own, unit)
                at, who = hit[near], own[near]
                breaks = np.flatnonzero((np.diff(at) > 2 * longest) | (np.diff(who) != 0)) + 1
                rows = []
                for h in np.split(at, breaks) if len(at) else ():
                    d = owner[h[0]]
                    lo, hi = max(starts[d], h[0] - longest), min(starts[d + 1], h[-1] + unit.width + longest)
                    rows.append((names[texts[d][0]], u, lo - starts[d], ids[lo:hi].tobytes(), (h - lo).astype("int32"), keys[h].view("int64")))
                if rows:
                    yield pd.DataFrame(rows, columns=["id", "unit", "first", "ids", "at", "keys"]).assign(key=pd.array([None] * len(rows), "Int64"), n=pd.array([None] * len(rows), "Int64"))[names_of(SCANNED)]
            if sum(map(len, seen)) > 2_000_000:
                yield counted(*counts(seen))
                seen = []
        yield counted(*counts(seen))

    src = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("t")).dropna()
    return src.mapInPandas(filled(part), SCANNED)


def names_of(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def counted(keys: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """Rows of counts alone."""
    return pd.DataFrame({"key": keys.view("int64"), "n": n.astype("int64")}).reindex(columns=names_of(SCANNED)).astype({"id": "Int64", "unit": "Int32", "first": "Int64", "ids": object, "at": object, "keys": object}).replace({np.nan: None})


def prefixes(keys: DataFrame, seen: DataFrame) -> DataFrame:
    """(item, pos, key): of every least run of every item the shingles that fewest documents hold; seen: (key, n)."""
    df = seen.groupBy("key").agg(F.sum("n").alias("n"))
    rows = keys.join(df, "key", "left").select("item", "unit", F.struct("pos", "key", F.coalesce("n", F.lit(0)).alias("n")).alias("x"))
    rows = rows.groupBy("item", "unit").agg(F.sort_array(F.collect_list("x")).alias("x")).select("item", "unit", "x.key", "x.n")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, u, key, n in zip(b["item"], b["unit"], b["key"], b["n"], strict=True):
                unit, chosen = UNITS[u], np.zeros(len(key), bool)
                for k in range(len(key) - unit.span + 1):
                    run = slice(k, k + unit.span)
                    chosen[k + np.lexsort((key[run], n[run]))[: unit.prefix]] = True
                pos = np.flatnonzero(chosen)
                yield pd.DataFrame({"item": i, "pos": pos.astype("int32"), "key": np.asarray(key)[pos]})

    return rows.mapInPandas(filled(part), "item long, pos int, key long")


def holds(unit: Unit, ids: np.ndarray, item: np.ndarray, offset: int) -> bool:
    """Whether, the item laid at an offset, some run of the least length or more has few enough changes."""
    lo, hi = max(0, -offset), min(len(item), len(ids) - offset)
    if hi - lo < unit.least:
        return False
    changed = item[lo:hi] != ids[lo + offset : hi + offset]
    good = np.concatenate([[0], np.cumsum(1 - unit.tolerance * changed.astype("int64"))])
    return bool((good[unit.least :] >= np.minimum.accumulate(good)[: len(good) - unit.least]).any())


def leaks(docs: DataFrame, ident: str, text: str, items: DataFrame, item: str, passage: str) -> DataFrame:
    """(id, item): every document with every item it holds a passage of.

    Shuffled are the items, counts of their shingles, and the windows in which several stand. Joins are
    salted by document, so that a passage in a third of all documents is spread.
    """
    own = cut(numbered(items, item, passage))
    keys = item_keys(own)
    longest = own.agg(F.max(F.length("ids") / 4)).first()[0]
    rows = cut(scan(docs, ident, text, bit_filter(keys), int(longest or 0)))
    chosen = prefixes(keys, rows.where("key is not null").select("key", "n"))
    salted = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    salt = F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int").alias("salt")
    windows = rows.where("id is not null").select("id", "unit", "first", "ids", "at", "keys").dropDuplicates(["id", "unit", "first"])
    hits = windows.select("id", "unit", "first", salt, F.explode(F.arrays_zip("at", "keys")).alias("x")).select("id", "unit", "first", "salt", "x.at", F.col("x.keys").alias("key"))
    pairs = hits.join(chosen.select("item", "pos", "key", salted), ["key", "salt"]).select("id", "unit", "first", "salt", "item", (F.col("at") - F.col("pos")).alias("offset")).distinct()
    found = pairs.join(windows.select("id", "unit", "first", "ids"), ["id", "unit", "first"]).join(own.select("item", "unit", F.col("ids").alias("its"), salted), ["item", "unit", "salt"])
    n, m = (F.length(c) / 4 for c in ("its", "ids"))
    least = F.element_at(F.array(*[F.lit(u.least) for u in UNITS]), F.col("unit") + 1)
    found = found.where(F.least(n, m - F.col("offset")) - F.greatest(F.lit(0), -F.col("offset")) >= least)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [holds(UNITS[u], np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), o) for u, x, y, o in zip(b["unit"], b["ids"], b["its"], b["offset"], strict=True)]
            yield b.loc[ok, ["id", "item"]]

    return found.select("id", "item", "unit", "ids", "its", "offset").mapInPandas(filled(part), "id long, item long").distinct()
