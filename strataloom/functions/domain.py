"""Domain distributions: keyword, structure and name evidence per axis, as one softmax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataloom.functions import text as X
from strataloom.functions import vector as V

# Weights of the kinds of evidence.
KEYWORDS, ENTITIES, STRUCTURE, NAME = 0.5, 0.3, 0.15, 0.05
ENTITY, QUERY_PATTERN = 0.5, 1.5
DOMAIN_AXES = (
    "factual_definition", "method_algorithm", "comparison_analysis", "research_paper", "technical_code", "biological_science", "instruction_howto", "business_finance",
)
ENTITY_AXES = {
    "ALGORITHM": ("method_algorithm",), "MODEL": ("method_algorithm", "technical_code"), "TECHNIQUE": ("method_algorithm",), "PERSON": ("research_paper",),
    "ORGANIZATION": ("research_paper", "business_finance"), "DATASET": ("research_paper",), "SOFTWARE": ("technical_code",), "PROTEIN": ("biological_science",),
    "GENE": ("biological_science",), "SCIENTIFIC_TERM": ("biological_science", "research_paper"), "METHOD": ("method_algorithm",),
    "METRIC": ("comparison_analysis", "research_paper"),
}
QUERY_PATTERNS = {
    "method_algorithm": ("thuật toán", "algorithm", "phương pháp", "method", "hoạt động", "cơ chế", "kỹ thuật"),
    "comparison_analysis": ("so sánh", "khác nhau", "compare", "hơn kém", "tại sao", "tại sao", "vai trò", "đánh giá"),
    "factual_definition": ("là gì", "what is", "viết tắt", "bao nhiêu", "bao gồm", "gồm", "có gì"),
    "instruction_howto": ("làm thế nào", "như thế nào", "cách", "how to", "hướng dẫn", "bước", "thực hiện"),
    "biological_science": ("protein", "dự đoán", "cấu trúc", "biology"),
}


def tag(text: Column, name: Column, axes: dict[str, dict[str, float]], structure: dict[str, str], types: Column | None = None, entity_axes: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Array of probabilities in the order of ``axes``: keyword weights, a structural pattern, the file name, and the types of
    the entities in the text (an array, repeated types counting each time) by the axes they speak for."""

    def scores(low: Column) -> Column:
        out = []
        for axis, words in axes.items():
            shape = text.rlike("(?mi)" + structure[axis]).cast("double") if axis in structure else F.lit(0.0)
            spoken = entity_evidence(types, axis, entity_axes or ENTITY_AXES) if types is not None else F.lit(0.0)
            out.append(KEYWORDS * X.lower_score(low, words) + ENTITIES * spoken + STRUCTURE * shape + NAME * F.lower(name).contains(axis).cast("double"))
        return F.array(*out)

    return V.softmax(V.once(F.lower(text), scores))  # a text is put in lower case once


def dominant(distribution: Column, axes: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, axes)), F.array_position(distribution, F.array_max(distribution)).cast("int"))


def entity_evidence(types: Column, axis: str, entity_axes: dict[str, tuple[str, ...]]) -> Column:
    kinds = [k for k, axes in entity_axes.items() if axis in axes]
    return ENTITY * F.size(F.filter(F.coalesce(types, F.array().cast("array<string>")), lambda t: F.upper(t).isin(*kinds))) if kinds else F.lit(0.0)


def tag_entities(types: Column, axes: tuple[str, ...] = DOMAIN_AXES, entity_axes: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Array of probabilities per axis from entity types alone; null where there are none."""
    scores = F.array(*[entity_evidence(types, axis, entity_axes or ENTITY_AXES) for axis in axes])
    return F.when(F.size(types) > 0, V.softmax(scores))


def tag_query(query: Column) -> Column:
    """Array of probabilities per axis of DOMAIN_AXES: every pattern that a question has counts QUERY_PATTERN."""
    text = F.lower(query)
    hits = lambda axis: sum((text.contains(p).cast("double") for p in QUERY_PATTERNS.get(axis, ())), F.lit(0.0))
    return V.softmax(F.array(*[QUERY_PATTERN * hits(axis) for axis in DOMAIN_AXES]))
