"""The entity graph as vertex and edge tables. Names are keyed in lower case; the display name stays an attribute.

vertices: (id, name, entity_type, description, language, pagerank); edges: (src, dst, rel_type, strength).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.session import cut

STRONGEST = (4096, 65_536)  # edges that queries are tried against before all edges around them are listed


def follows(chunks: DataFrame, ident: str, text: str, order: list[str], within: str) -> tuple[DataFrame, DataFrame]:
    """A vertex for each chunk and an edge to the next one of its document."""
    nxt = F.lead(ident).over(Window.partitionBy(within).orderBy(*order))
    rows = chunks.select("*", nxt.alias("_next"))
    vertices = rows.select(F.col(ident).alias("id"), F.substring(text, 1, 200).alias("description"))
    edges = rows.where("_next is not null").select(F.col(ident).alias("src"), F.col("_next").alias("dst"), F.lit("follows").alias("rel_type"), F.lit(0.7).alias("strength"))
    return vertices, edges


def load(entities: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices by lower-case name, the last row of a name winning, and the edges whose two ends exist.

    entities: (pos, entity_name, entity_type, description); relationships: (src_id, tgt_id, keywords, weight).
    """
    key = F.lower(F.trim("entity_name"))
    last = entities.where(key != "").groupBy(key.alias("id")).agg(F.max_by(F.struct("entity_name", "entity_type", "description"), "pos").alias("e"))
    vertices = last.select("id", F.col("e.entity_name").alias("name"), F.col("e.entity_type").alias("entity_type"), F.col("e.description").alias("description"), F.lit("zh").alias("language"))
    rel = F.coalesce(F.expr("nullif(trim(keywords), '')"), F.lit("related"))
    edges = relationships.select(F.lower(F.trim("src_id")).alias("src"), F.lower(F.trim("tgt_id")).alias("dst"), rel.alias("rel_type"), F.coalesce("weight", F.lit(1.0)).alias("strength"))
    ids = vertices.select("id")
    edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return vertices, edges


def incident(edges: DataFrame, ids: DataFrame, *keys: str) -> DataFrame:
    """(keys, src, dst, rel_type, strength) of edges at either end of ids, each pair once; out of an id comes before into one.

    ids: (keys, id); keys such as query_id tell sets of ids apart.
    """
    ids = ids.select(*keys, "id").distinct()
    sides = [edges.join(ids.withColumnRenamed("id", end), end).withColumn("into", F.lit(k)) for k, end in enumerate(("src", "dst"))]
    every = reduce(DataFrame.unionByName, [x.select(*keys, "src", "dst", "rel_type", "strength", "into") for x in sides])
    best = every.groupBy(*keys, "src", "dst").agg(F.min(F.struct("into", (-F.col("strength")).alias("s"), "rel_type")).alias("b"))
    return best.select(*keys, "src", "dst", F.col("b.rel_type").alias("rel_type"), (-F.col("b.s")).alias("strength"))


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int, *keys: str) -> DataFrame:
    """(keys, seed, id, hops): what lies within so many undirected hops of each seed, the seed itself left out, by least hops. seeds: (keys, id)."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    reached = seeds.select(*keys, F.col("id").alias("seed"), "id", F.lit(0).alias("hops")).distinct()
    front = reached
    for n in range(1, hops + 1):
        step = front.join(both, front["id"] == both["src"]).select(*keys, "seed", F.col("dst").alias("id"), F.lit(n).alias("hops")).distinct()
        front = step.join(reached.select(*keys, "seed", "id"), [*keys, "seed", "id"], "left_anti")
        reached = reached.unionByName(front)
    return reached.where("hops > 0")


def pagerank(vertices: DataFrame, edges: DataFrame, iterations: int = 100, damping: float = 0.85, every: int = 5, tolerance: float | None = 1e-6) -> DataFrame:
    """(id, pagerank): weighted and directed, the mass of vertices without edges shared by all.

    A round is one join and one aggregation; the dangling mass is a one-row table joined in, so no round
    waits for the driver. Lineage is cut in the shared folder every few rounds; there the rounds end too
    if the last one's changes sum to less than `tolerance` a vertex (null: all rounds are run). Parallel
    edges collapse to the greatest strength.
    """
    ids = vertices.select("id").distinct()
    one = edges.where("strength > 0").groupBy("src", "dst").agg(F.max("strength").alias("strength"))
    total = one.groupBy("src").agg(F.sum("strength").alias("out"))
    share = cut(one.join(total, "src").select("src", "dst", (F.col("strength") / F.col("out")).alias("share")))
    n = ids.agg(F.count("*").alias("n"))
    has = total.select(F.col("src").alias("id"), F.lit(True).alias("has"))
    first = (1.0 / F.col("n")).alias("r")
    rank = cut(ids.join(has, "id", "left").crossJoin(F.broadcast(n)).select("id", F.coalesce("has", F.lit(False)).alias("has"), "n", first, F.lit(0.0).alias("was")))
    for i in range(iterations):
        dangling = rank.agg(F.sum(F.when(~F.col("has"), F.col("r")).otherwise(0.0)).alias("d"))
        got = rank.join(share, rank["id"] == share["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("r") * F.col("share")).alias("got"))
        new = (1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("d") / F.col("n"))
        rank = rank.join(got, "id", "left").crossJoin(F.broadcast(dangling)).select("id", "has", "n", new.alias("r"), F.col("r").alias("was"))
        if (i + 1) % every == 0:
            rank = cut(rank)
            moved = rank.agg(F.sum(F.abs(F.col("r") - F.col("was"))).alias("moved"), F.max("n").alias("n")).first() if tolerance is not None else None
            if moved and (moved.moved is None or moved.moved < moved.n * tolerance):
                break
    return rank.select("id", F.col("r").alias("pagerank"))


def _first(df: DataFrame, top_k: int, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= top_k)


def entities(vertices: DataFrame, edges: DataFrame, seeds: DataFrame, top_k: int = 5, hops: int = 2) -> DataFrame:
    """The entities around the scored seeds (query_id, id, score) of each query by score x page rank; vertices with pagerank.

    A neighbour scores min(0.95, 0.6 / (hops + 1)) and replaces a seed that it is; a seed's page rank counts 0.1.
    """
    near = neighbours(edges, seeds, hops, "query_id").select("query_id", "id").distinct()
    known = near.join(vertices.select("id", "pagerank"), "id").select("query_id", "id", F.lit(min(0.95, 0.6 / (hops + 1))).alias("score"), "pagerank")
    own = seeds.join(near, ["query_id", "id"], "left_anti").groupBy("query_id", "id").agg(F.max("score").alias("score")).withColumn("pagerank", F.lit(0.1))
    every = known.unionByName(own).withColumn("weight", F.round(F.col("score") * F.col("pagerank"), 9))
    return _first(every, top_k, F.desc("weight"), "id")


def relations(edges: DataFrame, seeds: DataFrame, top_k: int = 5, hops: int = 2) -> DataFrame:
    """The edges at the seeds (query_id, id) of each query and at what lies within so many hops of them, by strength.

    Queries are first tried against the strongest edges of all, only whose ends the last hop has to reach: top_k
    of them that touch a query are its result. All edges around are listed only for queries still left over.
    """
    order = (F.desc("strength"), "src", "dst")
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    step = lambda near, to: near.join(to, near["id"] == to["src"]).select("query_id", F.col("dst").alias("id"))
    near = seeds.select("query_id", "id").distinct()
    for _ in range(hops - 1):
        near = near.union(step(near, both)).distinct()
    near, done = cut(near), []
    for n in STRONGEST:
        strongest = cut(edges.orderBy(*order, "rel_type").limit(n))
        ends = F.broadcast(strongest.select(F.col("src").alias("id")).union(strongest.select("dst")).distinct())
        touched = near.join(ends, "id", "left_semi").select("query_id", "id")
        if hops > 0:
            touched = touched.union(step(near, both.join(ends, both["dst"] == ends["id"], "left_semi")))
        found = cut(_first(incident(strongest, touched, "query_id"), top_k, *order))
        if strongest.count() < n:  # these are all edges
            return reduce(DataFrame.unionByName, [*done, found])
        full = found.where(F.col("rank") == top_k).select("query_id")
        done.append(found.join(full, "query_id", "left_semi"))
        near = cut(near.join(full, "query_id", "left_anti"))
        if near.isEmpty():
            return reduce(DataFrame.unionByName, done)
    rest = near.union(step(near, both)) if hops > 0 else near
    return reduce(DataFrame.unionByName, [*done, _first(incident(edges, rest, "query_id"), top_k, *order)])


def search(vertices: DataFrame, edges: DataFrame, seeds: DataFrame, top_k: int = 5, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) around the scored seeds (query_id, id, score) of each query; vertices with pagerank."""
    return entities(vertices, edges, seeds, top_k, hops), relations(edges, seeds, top_k, hops)


def result_rows(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Both as results (query_id, doc, content, score, channel, rank)."""
    e = entities.select("query_id", F.col("id").alias("doc"), F.concat(F.lit("[Entity] "), "id").alias("content"), F.coalesce("score", F.lit(0.5)).alias("score"), F.lit("graph/entity").alias("channel"), "rank")
    r = relationships.select(
        "query_id", F.concat_ws("_", "src", "rel_type", "dst").alias("doc"), F.format_string("[Relationship] %s --[%s]--> %s", "src", "rel_type", "dst").alias("content"),
        F.coalesce("strength", F.lit(0.3)).alias("score"), F.lit("graph/relationship").alias("channel"), "rank",
    )
    return e.unionByName(r)


def stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.agg(F.count("*").alias("entities")).crossJoin(edges.agg(F.count("*").alias("relationships")))


def between(edges: DataFrame, src: str | None = None, dst: str | None = None) -> DataFrame:
    """Edges of a source, a target, or both, whatever the letter case."""
    for end, name in (("src", src), ("dst", dst)):
        if name is not None:
            edges = edges.where(F.lower(end) == name.lower())
    return edges


def lookup(vertices: DataFrame, names: DataFrame) -> DataFrame:
    """Vertices whose id or name is among names (name), each once: two equi joins, those found by id left out of the second."""
    keys = names.select(F.lower("name").alias("_key")).distinct()
    by_id = vertices.join(keys, F.lower(vertices["id"]) == keys["_key"], "left_semi")
    rest = vertices.join(keys, F.lower(vertices["id"]) == keys["_key"], "left_anti")
    return by_id.unionByName(rest.join(keys, F.lower(rest["name"]) == keys["_key"], "left_semi"))
