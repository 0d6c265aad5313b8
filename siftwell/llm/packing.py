"""Filling fixed-capacity containers with items, by large-item matching.

Items above a third of the capacity are matched first, at most two to a container: the largest with
the largest that still fits. Smaller items, largest first, then go where least room is left. Items
larger than a container are split into full containers and a rest that is packed like any item.
Items are dealt to shards of bounded size by a hash of their id, which levels the sizes in each
shard; a shard leaves at most a container or so part-empty, so the loss vanishes with its size.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that are tokens by themselves; Java regular expressions.
SINGLE = r"\p{IsHan}\p{IsHangul}\u3040-\u30FF\u31F0-\u31FF\uFF66-\uFF9F"
#: Token: a Han, kana or Hangul character, else a run of letters and digits, else another visible character,
#: private-use ones, which fonts draw as bullets and symbols, among them.
TOKEN = rf"[{SINGLE}]|[\p{{L}}\p{{N}}\p{{M}}&&[^{SINGLE}]]+|[^\s\p{{Z}}\p{{Cc}}\p{{Cf}}\p{{Cs}}\p{{Cn}}]"


def token_count(text: Column) -> Column:
    """Tokens of a text; null for null, 0 for empty."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item; every size is from 1 to capacity."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    large = [i for i in order if 3 * sizes[i] > capacity]
    bins = [-1] * len(sizes)
    made = 0
    gaps: list[tuple[int, int]] = []  # (room left, container)
    # The largest takes the largest partner that fits: partners stand in ascending order of size.
    rest = sorted((sizes[i], i) for i in large)
    while rest:
        size, i = rest.pop()
        bins[i] = made
        at = bisect_left(rest, (capacity - size + 1, -1)) - 1
        if at >= 0:
            other, j = rest.pop(at)
            bins[j] = made
            size += other
        if size < capacity:
            gaps.append((capacity - size, made))
        made += 1
    gaps.sort()
    for i in order:
        if bins[i] >= 0:
            continue
        at = bisect_left(gaps, (sizes[i], -1))
        if at < len(gaps):
            room, b = gaps.pop(at)
        else:
            room, b = capacity, made
            made += 1
        bins[i] = b
        if room > sizes[i]:
            insort(gaps, (room - sizes[i], b))
    return bins


def fill(items: DataFrame, ident: str, size: Column, capacity: int = 1024, shard_items: int = 20_000) -> DataFrame:
    """(id, part, parts, tokens, shard, container): where each item, or each part of an item larger than a container, goes.

    Containers are named by (shard, container). Items of size 0 or null and null ids take no room and
    are left out; repeated ids count once. Only ids and sizes are shuffled.
    """
    rows = items.select(F.col(ident).cast("long").alias("id"), size.alias("size")).where("id is not null and size > 0").groupBy("id").agg(F.max("size").alias("size"))
    shards = F.greatest(F.lit(1), F.ceil(F.lit(items.count() / shard_items)))
    cutup = rows.select("id", "size", F.ceil(F.col("size") / capacity).cast("int").alias("parts"), F.pmod(F.xxhash64("id"), shards).alias("shard"))

    def shard(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id", ignore_index=True)
        g = g.loc[g.index.repeat(g["parts"])].assign(part=lambda x: x.groupby(level=0).cumcount()).reset_index(drop=True)
        last = g["part"] + 1 == g["parts"]
        tokens = (g["size"] - capacity * g["part"]).where(last, capacity)
        return g.assign(tokens=tokens, container=pack([int(x) for x in tokens], capacity))[["id", "part", "parts", "tokens", "shard", "container"]]

    return cutup.groupBy("shard").applyInPandas(shard, "id long, part int, parts int, tokens long, shard long, container long")
