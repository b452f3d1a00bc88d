"""Scoring rules: factors, path weights, rerank features, gates, time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factors and weights that results depend on.
LEVEL_FACTORS = {"sentence": 0.8, "paragraph": 1.0, "section": 1.1, "document": 0.7}
PATH_WEIGHTS = {
    "original": 1.0, "rewrite": 1.1, "hyde": 1.3, "step_back": 0.8, "keywords": 0.9, "decompose": 1.1,
    "entity_pivot": 1.5, "graph": 1.0, "community": 1.2, "entity_cosine": 1.6, "ppr": 1.7, "entity_gate": 1.8,
}
GRAPH_PATHS = ("entity_pivot", "graph", "community", "entity_cosine", "ppr", "entity_gate")
GRAPH_SCALE = 0.2
RRF_K = 60
RERANK_WEIGHTS = {
    "stage2_score": 0.25, "cosine_dense": 0.10, "cosine_graph_aware": 0.20, "consistency_score": 0.10, "chunk_level_factor": 0.05,
    "entity_match_count_norm": 0.15, "path_confidence": 0.05, "recency_score": 0.03, "retrieval_path_weight": 0.04,
    "format_match_score": 0.01, "source_quality_score": 0.02,
}


def from_table(key: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for name, value in table.items():
        out = F.when(key == name, F.lit(float(value))).otherwise(out)
    return out


def level_factor(level: Column) -> Column:
    return from_table(level, LEVEL_FACTORS, 1.0)


def consistency_factor(score: Column) -> Column:
    return F.when(score >= 0.85, 1.2).when(score >= 0.60, 1.0).otherwise(0.8)


def consistency_class(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.60, "normal").otherwise("low")


def path_weight(path: Column, scale: float = GRAPH_SCALE) -> Column:
    return from_table(path, {p: w * (scale if p in GRAPH_PATHS else 1.0) for p, w in PATH_WEIGHTS.items()}, 1.0)


def recency(as_of: Column, created: Column) -> Column:
    days = F.greatest(F.datediff(as_of, created), F.lit(0))
    return F.when(created.isNull(), F.lit(0.7)).otherwise(F.greatest(F.lit(0.3), F.pow(F.lit(0.5), days / 365.0)))


def surfaced_weight(path: Column) -> Column:
    # Weights of the paths by which a chunk came up.
    p = F.lower(path)
    return (
        F.when(p.isNull() | (p == ""), 0.5)
        .when(p.contains("graph_aware"), 1.0)
        .when(p.contains("entity_pivot") | p.contains("react:entity"), 0.95)
        .when(p.contains("sparse") | p.contains("keywords"), 0.7)
        .when(p.contains("summary"), 0.65)
        .when(p.contains("step_back"), 0.5)
        .otherwise(0.6)
    )


def rerank_score(features: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    weights = weights or RERANK_WEIGHTS
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + features.get(name, F.lit(0.0)) * weight
    return total / sum(weights.values())


def final_score(stage2: Column, rerank: Column) -> Column:
    return 0.4 * stage2 + 0.6 * rerank


def grounding_credit(cosine: Column) -> Column:
    return F.when(cosine >= 0.60, 1.0).when(cosine <= 0.40, 0.0).otherwise((cosine - 0.40) / 0.20)


def confidence(grounded: Column, entities_pass: Column, citations_pass: Column) -> Column:
    return grounded * F.when(entities_pass, 1.0).otherwise(0.8) * F.when(citations_pass, 1.0).otherwise(0.9)


def corrective_action(entities_pass: Column, citations_pass: Column, grounded: Column) -> Column:
    failed = F.when(~entities_pass, "expand_entities").when(~citations_pass, "rewrite_with_citations").when(~grounded, "retrieve_more")
    return failed.otherwise("accept")


def degree_penalty(score: Column, degree: Column, gamma: float) -> Column:
    return score / F.pow(1 + degree, F.lit(gamma))


def domain_reward(cosine: Column, scale: float = 1.0) -> Column:
    return (cosine + 1) / 2 * scale


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Closed intervals; a null end is open."""
    return (start.isNull() | (start <= high)) & (end.isNull() | (end >= low))


def temporal_intent(query: Column) -> Column:
    """Struct (type, year, quarter, low, high): current, latest, a year, a quarter, the past or none, in this order.

    A quarter ends on day 30 of its last month.
    """
    # Words of time.
    q = F.lower(query)
    year = F.regexp_extract(q, r"(?iuU)\b(năm|in)\s+(\d{4})\b", 2)
    quarter = F.regexp_extract(q, r"(?iuU)\b(quý|q)\s*([1-4])\s*(năm)?\s*(\d{4})\b", 2).try_cast("int")  # so "q2 2023" as well
    quarter_year = F.regexp_extract(q, r"(?iuU)\b(quý|q)\s*([1-4])\s*(năm)?\s*(\d{4})\b", 4).try_cast("int")
    none = F.lit(None)

    def made(kind, y=none, n=none, low=none, high=none):
        return F.struct(F.lit(kind).alias("type"), y.cast("int").alias("year"), n.cast("int").alias("quarter"), low.cast("date").alias("low"), high.cast("date").alias("high"))

    y = year.try_cast("int")
    return (
        F.when(q.rlike(r"(?iuU)\b(hiện tại|hiện nay|bây giờ|now|current|today)\b"), made("current"))
        .when(q.rlike(r"(?iuU)\b(mới nhất|gần đây nhất|latest|most recent)\b"), made("latest"))
        .when(year != "", made("specific", y, none, F.make_date(y, F.lit(1), F.lit(1)), F.make_date(y, F.lit(12), F.lit(31))))
        .when(
            quarter.isNotNull(),
            made("specific", quarter_year, quarter, F.make_date(quarter_year, 3 * quarter - 2, F.lit(1)), F.make_date(quarter_year, 3 * quarter, F.lit(30))),
        )
        .when(q.rlike(r"(?iuU)\b(năm ngoái|tháng trước|last year|last month)\b"), made("past"))
        .otherwise(made("none"))
    )
