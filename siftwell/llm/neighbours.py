"""Most similar vectors for every vector: vantage-point trees per shard.

A routing tree of vantage points, fitted on a bounded sample of different vectors, assigns every vector
to a shard; a vector is also sent, as a query, to each shard whose region its search ball may touch. The
tree halves its sample at each step, so shards hold about equal numbers of vectors, and has as many
leaves as keep them to their size at any total. A region is ruled out by the triangle inequality on
angles, the ball's radius being multiplied by `relax` first: 1 is exact, less is faster and may miss
neighbours that lie just behind a border. The radius is the angle of the k-th neighbour found in the
vector's own shard, or of `at_least` if that is smaller. A shard is searched by its own vantage-point
tree, exactly; a shard's visitors are streamed past it and never gathered.

Equal vectors are one class, searched once and expanded at the end, so that masses of copies meet no
shard. Vectors that are null, of another length, all zero or not finite have no neighbours and are
none; repeated ids count once; equal similarities are ordered by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.session import cut, filled

LEAF = 1024
BLOCK = 4096  # queries that meet a leaf at once
#: For all nearest, without a least similarity: recall@5 of 0.9 or more at the sizes measured (see README).
RELAX_ALL = 0.25


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype("float64")
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype("float32")


def angle(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1.0, 1.0))


class Tree:
    """A vantage-point tree over unit vectors; leaves hold row numbers. The vantage point of widest spread of some is taken."""

    def __init__(self, v: np.ndarray, rows: np.ndarray, leaf: int, depth: int = 64, tries: int = 8, seed: int = 0) -> None:
        self.rows: np.ndarray | None = rows
        if len(rows) <= leaf or depth == 0:
            return
        rng = np.random.default_rng(seed + len(rows))
        probe = rows if len(rows) <= 1000 else rng.choice(rows, 1000, replace=False)
        tried = rng.choice(rows, min(tries, len(rows)), replace=False)
        point = v[tried[angle(v[probe] @ v[tried].T).std(axis=0).argmax()]]
        d = angle(v[rows] @ point)
        border = float(np.median(d))
        inner = d < border
        if not inner.any() or inner.all():
            return
        self.point, self.border, self.rows = point, border, None
        self.inside, self.outside = (Tree(v, rows[m], leaf, depth - 1, tries, seed) for m in (inner, ~inner))

    def leaves(self) -> Iterator[Tree]:
        if self.rows is not None:
            yield self
        else:
            yield from self.inside.leaves()
            yield from self.outside.leaves()

    def route(self, q: np.ndarray, at: np.ndarray, reach: np.ndarray, out: list[tuple[Tree, np.ndarray, np.ndarray]], home: np.ndarray) -> None:
        """Collect (leaf, queries, whether it is their own) for every leaf that the queries' balls may touch."""
        if self.rows is not None:
            out.append((self, at, home))
            return
        d = angle(q[at] @ self.point)
        for side, gap, own in ((self.inside, d - self.border, d < self.border), (self.outside, self.border - d, d >= self.border)):
            m = own | (gap <= reach[at])
            if m.any():
                side.route(q, at[m], reach, out, home[m] & own[m])

    def search(self, v: np.ndarray, q: np.ndarray, at: np.ndarray, best: Best, relax: float) -> None:
        """Improve the best of the queries `at`; the nearer side first, the other with the smaller radius."""
        if self.rows is not None:
            own = v[self.rows].T
            for k in range(0, len(at), BLOCK):
                best.offer(at[k : k + BLOCK], self.rows, q[at[k : k + BLOCK]] @ own)
            return
        d = angle(q[at] @ self.point)
        inner = d < self.border
        for first, second, m in ((self.inside, self.outside, inner), (self.outside, self.inside, ~inner)):
            if m.any():
                first.search(v, q, at[m], best, relax)
                rest = at[m][np.abs(d[m] - self.border) <= relax * best.radius(at[m])]
                if len(rest):
                    second.search(v, q, rest, best, relax)


class Best:
    """The k best of each query so far, and its search radius."""

    def __init__(self, own: np.ndarray, k: int, floor: np.ndarray) -> None:
        self.k, self.own, self.floor = k, own, floor
        self.column = np.full(max(0, int(own.max(initial=-1))) + 1, -1)  # of each row in the leaf at hand
        self.cos = np.full((len(own), k), -2.0, "float32")
        self.row = np.full((len(own), k), -1, "int64")

    def radius(self, at: np.ndarray) -> np.ndarray:
        return angle(np.maximum(self.cos[at, -1], self.floor[at]))

    def offer(self, at: np.ndarray, rows: np.ndarray, cos: np.ndarray) -> None:
        own = self.own[at]
        if (own >= 0).any():  # a vector is not its own neighbour
            self.column[rows] = np.arange(len(rows))
            mine = self.column[own]
            cos[np.flatnonzero(mine >= 0), mine[mine >= 0]] = -3
            self.column[rows] = -1
        least = np.maximum(np.nextafter(self.cos[at, -1], np.float32(3)), self.floor[at] - np.float32(1e-6))
        hit = np.flatnonzero(cos.max(axis=1) >= least)
        if not len(hit):
            return
        got, take = cos[hit], min(self.k, cos.shape[1])
        top = np.argpartition(-got, take - 1, axis=1)[:, :take]
        every = np.concatenate([self.cos[at[hit]], np.take_along_axis(got, top, 1)], axis=1)
        which = np.concatenate([self.row[at[hit]], rows[top]], axis=1)
        order = np.argsort(-every, axis=1, kind="stable")[:, : self.k]
        self.cos[at[hit]] = np.take_along_axis(every, order, 1)
        self.row[at[hit]] = np.take_along_axis(which, order, 1)


def _matrix(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), "<f4").reshape(len(col), -1)


def finite(df: DataFrame, ident: str, vector: str, dim: int) -> DataFrame:
    """(id, vec) of the usable vectors: of the length, finite and not all zero."""
    rows = df.select(F.col(ident).alias("id"), F.col(vector).alias("vec")).where(f"id is not null and size(vec) = {dim}")
    # NaN is greater than infinity to Spark, so one comparison rejects both.
    return rows.where(F.coalesce(F.forall("vec", lambda x: F.abs(x) < float("inf")), F.lit(False)) & F.exists("vec", lambda x: x != 0))


def classes(df: DataFrame, ident: str, vector: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(members, reps): (id, h1, h2) of every usable vector, and (id, vec) of the least id of each class of equal vectors.

    Copies are merged before the shuffle; members carry hashes only.
    """
    v = F.col("vec")
    rows = finite(df, ident, vector, dim).select("id", "vec", F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"))
    reps = rows.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.any_value("vec").alias("vec")).select("id", "vec")
    return rows.select("id", "h1", "h2").distinct(), reps


def usable(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ids and vectors of rows whose vectors are finite and not all zero."""
    v = np.array([np.array([np.nan if x is None else x for x in r] if None in r else r, "float32") for r in map(list, b["vec"])], "float32")
    ok = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
    return b["id"].to_numpy()[ok], v[ok]


def routing(df: DataFrame, total: int, shard: int, fit_rows: int, a_leaf: int = 8) -> Tree:
    """The tree that deals total vectors to shards, fitted on about fit_rows rows of least hashed id, or `a_leaf` for each shard if that is more."""
    depth = max(0, math.ceil(math.log2(max(1, total) / shard)))
    wanted = max(fit_rows, a_leaf << depth)
    upto = min(2**63 - 1, int(-(2**63) + min(1.0, wanted / max(1, total)) * (2**64 - 1)))
    drawn = df.where(F.xxhash64("id") <= upto).dropDuplicates(["id"]).orderBy("id").toPandas()
    sample = unit(np.unique(usable(drawn)[1], axis=0)) if len(drawn) else np.zeros((0, 1), "float32")
    return Tree(sample, np.arange(len(sample)), 1, depth=depth, tries=32)


def exact(v: np.ndarray, q: np.ndarray, best: Best, at_least: float | None, rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Similarities of the rows found for each query in double precision, and which of them count; v, q: raw vectors, a few rows at a time."""
    wide = lambda x: (y := x.astype("float64")) / np.linalg.norm(y, axis=-1, keepdims=True)
    cos = np.concatenate([np.einsum("ij,ikj->ik", wide(q[k : k + rows]), wide(v[best.row[k : k + rows]])) for k in range(0, len(q), rows)])
    return cos, (best.row >= 0) & (cos >= (-2 if at_least is None else at_least))


def search(df: DataFrame, reps: DataFrame, k: int, at_least: float | None, relax: float, shard: int, fit_rows: int) -> DataFrame:
    """(id, other, similarity): each vector's k nearest others found, ids being distinct. The tree is fitted on rows of df."""
    spark = reps.sparkSession
    tree = routing(df, df.count(), shard, fit_rows)
    shared = spark.sparkContext.broadcast(tree)
    # A task for each shard or two, however many there are: the session's number of partitions is for any size.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(1 for _ in tree.leaves()))

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = {id(leaf): n for n, leaf in enumerate(shared.value.leaves())}
        for b in batches:
            ids, raw = usable(b)
            out: list[tuple[Tree, np.ndarray, np.ndarray]] = []
            if len(ids):
                shared.value.route(unit(raw), np.arange(len(ids)), np.full(len(ids), -10.0), out, np.ones(len(ids), bool))
            sent = np.array([x.tobytes() for x in raw], object)
            for leaf, at, _ in out:
                yield pd.DataFrame({"shard": number[id(leaf)], "id": ids[at], "vec": sent[at]})

    def at_home(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id", ignore_index=True)
        raw, every = _matrix(g["vec"]), np.arange(len(g))
        q = unit(raw)
        best = Best(every, k, np.full(len(g), -1.0 if at_least is None else at_least, "float32"))
        Tree(q, every, LEAF).search(q, q, every, best, 1.0)
        floor, ids = np.maximum(best.floor, best.cos[:, -1]), g["id"].to_numpy()
        cos, ok = exact(raw, raw, best, at_least)
        others, sims = [ids[r[m]] for r, m in zip(best.row, ok, strict=True)], [c[m] for c, m in zip(cos, ok, strict=True)]
        return g.assign(floor=floor, others=others, sims=sims)[["shard", "id", "vec", "floor", "others", "sims"]]

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = {id(leaf): n for n, leaf in enumerate(shared.value.leaves())}
        for b in batches:
            q, floor = unit(_matrix(b["vec"])), b["floor"].to_numpy("float32")
            out: list[tuple[Tree, np.ndarray, np.ndarray]] = []
            shared.value.route(q, np.arange(len(q)), relax * angle(floor), out, np.ones(len(q), bool))
            for leaf, at, own in out:
                yield pd.DataFrame({"shard": number[id(leaf)], "id": b["id"].to_numpy()[at], "vec": b["vec"].to_numpy()[at], "home": own, "floor": floor[at]})

    def abroad(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by shard, a shard's own first: these make its tree, the others are answered as they come."""
        now, kept, tree = None, [], None
        for b in batches:
            for number, g in b.groupby("shard", sort=True):
                if number != now:
                    now, kept, tree = number, [], None
                own = g["home"].to_numpy("bool")
                if own.any():
                    kept.append(g.loc[own, ["id", "vec"]])
                g = g[~own]
                if not len(g) or not kept:
                    continue
                if tree is None:
                    every = pd.concat(kept, ignore_index=True)
                    ids, raw = every["id"].to_numpy(), _matrix(every["vec"])
                    v = unit(raw)
                    tree, kept = Tree(v, np.arange(len(v)), LEAF), [every.iloc[:0]]
                asked = _matrix(g["vec"])
                best = Best(np.full(len(g), -1), k, g["floor"].to_numpy("float32"))
                tree.search(v, unit(asked), np.arange(len(g)), best, 1.0)
                cos, ok = exact(raw, asked, best, at_least)
                which, place = np.nonzero(ok)
                yield pd.DataFrame({"id": g["id"].to_numpy()[which], "other": ids[best.row[which, place]], "similarity": cos[which, place]})

    # A vector is searched in its own shard first: where that holds k near ones, as in a mass of near-copies, its ball
    # is small by the time it may visit others.
    shards = reps.mapInPandas(filled(home), "shard long, id string, vec binary").repartition(tasks, "shard").groupBy("shard")
    first = cut(shards.applyInPandas(at_home, "shard long, id string, vec binary, floor float, others array<string>, sims array<double>"))
    visits = first.select("id", "vec", "floor").mapInPandas(filled(visit), "shard long, id string, vec binary, home boolean, floor float")
    second = visits.repartition(tasks, "shard").sortWithinPartitions("shard", F.desc("home"), "id").mapInPandas(filled(abroad), "id string, other string, similarity double")
    own = first.select("id", F.explode(F.arrays_zip("others", "sims")).alias("x")).select("id", F.col("x.others").alias("other"), F.col("x.sims").alias("similarity"))
    found = own.unionByName(second)
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return found.select("*", F.row_number().over(w).alias("k")).where(F.col("k") <= k).drop("k")


def nearest(df: DataFrame, ident: str, vector: str, dim: int, k: int = 5, at_least: float | None = None, relax: float = 0.12, shard: int = 16_384, fit_rows: int = 20_000) -> DataFrame:
    """(id, other, similarity): of every usable vector the k most similar others, of cosine at_least if it is given."""
    members, reps = classes(df, ident, vector, dim)
    near = search(finite(df, ident, vector, dim), reps, k, at_least, relax, shard, fit_rows)
    # Classes of several members: their first k + 1 ids stand for the class in other lists, and every member has a list.
    near = cut(near)  # ids and similarities
    per = members.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    several = members.join(per, ["h1", "h2"]).select("rep", "id")
    first = several.select("*", F.row_number().over(Window.partitionBy("rep").orderBy("id")).alias("r")).where(F.col("r") <= k + 1)
    lists = first.groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    open_ = near.join(lists.withColumnRenamed("rep", "other"), "other", "left").select("id", "similarity", F.explode(F.coalesce("ids", F.array("other"))).alias("other"))
    own = lists.select(F.col("rep").alias("id"), F.lit(1.0).alias("similarity"), F.explode("ids").alias("other"))
    both = open_.unionByName(own)
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    best = both.select("*", F.row_number().over(w).alias("r")).where(F.col("r") <= k + 1)
    single = best.join(lists.select(F.col("rep").alias("id")), "id", "left_anti").where(F.col("r") <= k)
    many = best.withColumnRenamed("id", "rep").join(several, "rep").where("id <> other")
    many = many.select("*", F.row_number().over(Window.partitionBy("id").orderBy("r")).alias("r2")).where(F.col("r2") <= k)
    return single.select("id", "other", "similarity").unionByName(many.select("id", "other", "similarity"))
