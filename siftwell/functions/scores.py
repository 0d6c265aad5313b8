"""Vector similarity and score functions as column expressions; sums run in double."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# How well two languages' scores carry over; other pairs 0.5.
AFFINITY = {
    ("en", "zh"): 0.7, ("en", "ja"): 0.65, ("en", "ko"): 0.65, ("zh", "ja"): 0.6, ("zh", "ko"): 0.6,
    ("ja", "ko"): 0.6, ("es", "fr"): 0.75, ("es", "de"): 0.7, ("fr", "de"): 0.75,
}
OTHER_PAIR, SAME_LANGUAGE = 0.5, 1.15
EPS = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 if either vector is all zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def saturate(score: Column) -> Column:
    """An unbounded score in [0, 1]."""
    return F.least(F.lit(1.0), score / (score + 1))


def minmax(score: Column, *keys: str) -> Column:
    """Scores of a list in [0, 1]; 0.5 where the list is constant."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi - lo < EPS, 0.5).otherwise((score - lo) / (hi - lo + EPS))


def sigmoid(score: Column, scale: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-score / scale))


def affinity(a: Column, b: Column) -> Column:
    table = F.create_map(*[F.lit(x) for (x1, x2), v in AFFINITY.items() for y1, y2 in ((x1, x2), (x2, x1)) for x in (f"{y1}-{y2}", v)])
    return F.when(a == b, 1.0).otherwise(F.coalesce(F.element_at(table, F.concat_ws("-", a, b)), F.lit(OTHER_PAIR)))


def cross_lingual(score: Column, query_lang: Column, lang: Column) -> Column:
    """A score adjusted for the languages of query and document; the same language is raised and may exceed 1."""
    return F.when(query_lang == lang, score * SAME_LANGUAGE).otherwise(score * affinity(query_lang, lang))
