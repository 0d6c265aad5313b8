"""Splitting oversized items at natural boundaries by agglomerative merging.

A text begins as atomic segments (words, or single characters of scripts without spaces); adjacent
pairs stand in a heap by the strength of the boundary between them, and the weakest boundaries are
merged first while the merged size plus the overlap fits. What remains are pieces cut at the
strongest boundaries; each piece but the first is preceded by the end of the text before it.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.session import filled

CHARS_PER_TOKEN = 4
ATOM = re.compile(r"[぀-ヿ㐀-鿿가-힣＀-￯、-〟]|[^\s぀-ヿ㐀-鿿가-힣＀-￯、-〟]+|\s+")
#: Boundary strengths, by what stands before the boundary.
LEVELS = ((re.compile(r"\n[ \t]*\n\s*$"), 6), (re.compile(r"\n\s*$"), 5), (re.compile(r"(?:[.!?…][\"'»”’)\]]*\s+|[。！？][」』”’）]*\s*)$"), 4), (re.compile(r"(?:[,;:–—]\s+|[，、；：]\s*)$"), 3), (re.compile(r"\s$"), 2))


def tokens(text: Column) -> Column:
    """The project's estimate: characters divided by four, rounded down; null for null."""
    return F.floor(F.length(text) / CHARS_PER_TOKEN)


def atoms(text: str, most: int) -> list[str]:
    """Segments that are never cut but where one alone is too large; white space stays with what it follows."""
    out: list[str] = []
    for m in ATOM.findall(text):
        if m.isspace() and out:
            out[-1] += m
        else:
            out.append(m)
    return [s[i : i + most] for s in out for i in range(0, len(s), most)]


def strength(left: str, right: str) -> int:
    """How natural it is to cut between two segments."""
    tail = left[-16:]
    for pattern, level in LEVELS:
        if pattern.search(tail):
            return level + (level == 6 and right.startswith("#"))
    return 1 if left[-1:].isalnum() and right[:1].isalnum() and ord(left[-1]) > 0x2E80 else 0


def pieces(text: str, limit: int = 512, overlap: int = 64) -> list[str]:
    """Pieces of at most limit tokens; consecutive ones share the overlap. A text that fits is one piece.

    Without its shared beginning, the pieces joined give the text. limit must exceed overlap.
    """
    if overlap >= limit:
        raise ValueError("limit must exceed overlap")
    if len(text) // CHARS_PER_TOKEN <= limit:
        return [text] if text else []
    shared = overlap * CHARS_PER_TOKEN
    full = limit * CHARS_PER_TOKEN + CHARS_PER_TOKEN - 1
    room = full - shared  # the first piece has no shared beginning and may be full
    segs = atoms(text, room)
    n = len(segs)
    size = [len(s) for s in segs]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive, stamp = [True] * n, [0] * n
    level = [strength(segs[i], segs[i + 1]) if i + 1 < n else 9 for i in range(n)]  # of the boundary behind i's last atom
    heap = [(level[i], size[i] + size[i + 1], i, 0, 0) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, both, i, si, sj = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or stamp[i] != si or stamp[j] != sj or both > (room if i else full):
            continue
        size[i], level[i], after[i], alive[j] = both, level[j], after[j], False
        stamp[i] += 1
        if after[i] < n:
            before[after[i]] = i
            heapq.heappush(heap, (level[i], size[i] + size[after[i]], i, stamp[i], stamp[after[i]]))
        if before[i] >= 0:
            p = before[i]
            heapq.heappush(heap, (level[p], size[p] + size[i], p, stamp[p], stamp[i]))
    out, at = [], 0
    for i in range(n):
        if alive[i]:
            out.append(text[max(0, at - shared) : at + size[i]])
            at += size[i]
    return out


def split_oversized(df: DataFrame, ident: str, text: str, keep: list[str], limit: int = 512, overlap: int = 64) -> DataFrame:
    """(id, piece_no, piece, *keep) for every row larger than the limit, repeated ids once.

    Rows with a null id or text, and those that fit, have no pieces; the size test runs in the scan's
    stage, so only oversized texts reach Python.
    """
    big = df.where(tokens(F.col(text)) > limit).select(F.col(ident).alias("id"), F.col(text).alias("_text"), *keep).dropna(subset=["id"])
    fields = [big.schema[k] for k in keep]
    schema = "id string, piece_no int, piece string" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in fields)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cut = [pieces(t, limit, overlap) for t in b["_text"]]
            b = b.drop(columns="_text").assign(piece=cut, piece_no=[list(range(len(c))) for c in cut])
            yield b.explode(["piece", "piece_no"], ignore_index=True)[["id", "piece_no", "piece", *keep]]

    return big.dropDuplicates(["id"]).mapInPandas(filled(part), schema)
