"""Text functions: names, masking, sentences, citations, quality, routing. Every function maps columns to a column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrase lists and patterns that results depend on. (?iu) folds case beyond ASCII.
ABBREVIATIONS = (
    "et al", "i.e", "e.g", "etc", "vs", "cf", "viz", "Fig", "Eq", "Sec", "Ch", "Tab", "Eqs", "Figs", "Mr", "Mrs", "Ms", "Dr", "Prof",
    "Inc", "Ltd", "Co", "Corp", "Jr", "Sr", "St", "No", "vol", "Vol", "pp", "p", "ed", "Eds", "TS", "PGS", "GS", "ThS", "KS", "BS", "CN",
)
HEDGES = (
    r"\bcó thể\b", r"\bchắc(?: chắn)?\b", r"\bcó lẽ\b", r"\bhình như\b", r"\bgiả định\b", r"\bdường như\b", r"\bnghi ngờ\b",
    r"\bmaybe\b", r"\bpossibly\b", r"\bperhaps\b", r"\bI think\b", r"\bsupposedly\b", r"\bseems like\b",
)
PROMOTION = (
    r"\btuyệt vời\b", r"\bđột phá\b", r"\b(siêu|cực kỳ)\s+\w+", r"\b#1 (về|cho)\b", r"\b(tốt|hàng đầu|đẳng cấp)\s+\w+", r"\bamazing\b",
    r"\bgame[- ]?chang(?:er|ing)\b", r"\brevolution(?:ary)?\b", r"\b(best|world[- ]class)\s+\w+", r"\bbreakthrough\b", r"\b(unique|unmatched)\b",
)
DRAFTS = (r"\bTODO\b", r"\bFIXME\b", r"\bDRAFT\b", r"\bWIP\b", r"\bXXX\b", r"\b\(\?\?\?\)\b", r"\[\s*placeholder\s*\]")
STRUCTURE = (r"```[\w]*\n[\s\S]+?```|`[^`]+`", r"(?m)^\|.*\|\n\|[\s\-:|]+\|", r"(?m)^\s*[-*+•]\s+\S+")
REFUSALS = (
    "không có đủ thông tin", "không tìm thấy", "không thể trả lời", "không đủ dữ liệu", "i don'?t have enough information", "insufficient information",
)
CITATION = r"(?i)\[(?:chunk[_\-]?id\s*[:=]?\s*)?([\w\-]+(?::[\w\-]+)?(?:::[\w\-]+)?)\]"
CITATION_PATH = r"(?i)\[doc[\w\-]+(?:::[\w\-]+)+\]"
OUT_OF_DOMAIN = (
    "thời tiết", "bitcoin", "giá .*hôm nay", "nấu (phở|canh|bún)", "tin tức", "news today", "weather", "stock price", "cook (pho|soup|recipe)",
    "news", "bóng đá", "sport", "football", "game", "làm bánh", "tập gym", "mua sắm", "du lịch",
)
CORPUS_WIDE = (
    "chủ đề (chính|nào|gì|lớn)", "(các|những) chủ đề", "xuyên (suốt )?(corpus|tài liệu|kho)", "toàn bộ (tài liệu|corpus|kho tài liệu)",
    "tổng (thể|quan|hợp)", "xu hướng (chung|chính|nổi bật)", "(điểm|nội dung) chung", "khái quát", "bức tranh (chung|tổng)",
    "main (theme|topic)", "(across|throughout) (the )?(corpus|document|dataset|collection)", "overall (theme|trend|topic|picture)",
    "high[- ]level (overview|summary)", "what are the .*(theme|topic|trend)",
)
INTENT_KEYWORDS = (
    ("summarization", ("tóm tắt", "tổng hợp", "tổng quan", "liệt kê")),
    ("analytical", ("tại sao", "vì sao", "bằng cách nào", "như thế nào")),
    ("comparison", ("so sánh", "khác nhau", "giống nhau", "ưu điểm", "nhược điểm")),
    ("multi_hop", ("mối liên hệ", "ảnh hưởng qua lại", "cả a và b")),
    ("kg_construction", ("knowledge graph", "schema", "ontology", "xây dựng đồ thị")),
)
REASONING_INTENTS = ("analytical", "comparison", "multi_hop", "kg_construction")
REASONING_KEYWORDS = (
    "so sánh", "khác", "khác nhau", "khác gì", "vs ", " vs.", "hơn ", "cả ", "vừa ", "compare", "difference", "khác biệt",
    "mối liên hệ", "liên quan đến", "ảnh hưởng", "dẫn đến", "qua lại", "thông qua", "bằng cách nào", "tại sao", "vì sao",
    "phân tích", "đánh giá", "tổng hợp", "lý do", "nguyên nhân", "ưu điểm", "nhược điểm", "trade-off", "trade off",
)
SENTENCE_STARTERS = (
    "Tôi", "Bạn", "Cái", "Khi", "Tại", "Trong", "Với", "Cho", "Nếu", "Vì", "Nó", "Họ", "Đây", "Đó", "Vậy", "Hãy", "Có", "Không", "Là",
)
GREETING = r"(?iu)^\s*(xin\s+chào|chào|hello|hi|hey|cảm\s+ơn|thanks?|thank\s+you|tạm\s+biệt|bye)\s*[!.?]*\s*$"
FOLLOW_UP = r"(?iuU)\b(còn\s+nữa|tiếp|giải\s+thích\s+thêm|cho\s+ví\s+dụ|chi\s+tiết\s+hơn|và\s+sao|rồi\s+sao|cụ\s+thể|làm\s+rõ)\b"
QUESTION = (
    r"(?iuU)(\?\s*$|\bla\s+gi\b|\blà\s+gì\b|\btại\s+sao\b|\bvì\s+sao\b|\bsao\s+lại\b|\bnhư\s+thế\s+nào\b|\blàm\s+(sao|thế\s+nào|cách\s+nào)\b"
    r"|\bbằng\s+cách\s+nào\b|\bkhi\s+nào\b|\bở\s+đâu\b|\bbao\s+nhiêu\b|\bbao\s+lâu\b|\bcó\s+phải\b|\bcó\s+nên\b|\bnên\s+làm\s+gì\b|\bso\s+sánh\b"
    r"|\bkhác\s+(gì|nhau|biệt)\b|\bgiữa\s+.+\s+và\b|\bgiải\s+thích\b|\bđịnh\s+nghĩa\b|\btóm\s+tắt\b|\bliệt\s+kê\b"
    r"|^\s*(what|why|how|when|where|who|which|is|are|do|does|can|could|should)\b)"
)
DISCOURSE = (
    "Tuy nhiên", "Ngoài ra", "Mặt khác", "Do đó", "Vì vậy", "Ngược lại", "Đồng thời", "Thứ nhất", "Thứ hai", "Thứ ba", "Tóm lại", "Cuối cùng",
    "Bên cạnh đó", "Hơn nữa", "Chẳng hạn", "Ví dụ", "However", "Moreover", "Furthermore", "In contrast", "On the other hand", "Conversely",
    "In addition", "Therefore", "Thus", "Firstly?", "Secondly?", "Thirdly?", "Finally", "In conclusion", "For example", "For instance",
)
MODES = (
    ("INSTRUCTION", (r"^(Bước \d|Step \d|First[,\.]|Next[,\.])", r"\b(hãy|please|let us|let's)\b")),
    ("OPINION", (r"\b(rất|cực kỳ|tuyệt|excellent|amazing|terrible)\b", r"\b(theo tôi|theo chúng tôi|in my opinion)\b", r"\b(có thể|chắc chắn|definitely|maybe|possibly)\b")),
    ("FACT", (r"\d+%", r"\d+\s*(tỷ|triệu|nghìn|million|billion)", r"\d{4}", r"là\s+\w+")),
)
MODE_HINTS = {
    "INSTRUCTION": r"^.{4}(?: \p{Nd}|.?[,.])|[hH][ãÃ][yY]|[pP][lL][eE][aA]|[lL][eE][tT][ ']",
    "OPINION": r"[ấẤựỰệỆóÓắẮ]|[xX][cC][eE][lL]|[mM][aA][zZ]|[rR][rR].[bB]|[hH][eE][oO] |[nN] [mM][yY] |[fF].[nN]|[yY][bB][eE]|[bB][lL][yY]",
    "FACT": r"\p{Nd}|[lL][àÀ]",
}
"""What no text of a mode is without; quick to look for. Letters with more than two forms (i, k, s) are left out."""
MASKS = (
    ("EMAIL", r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"),
    ("PHONE", r"(?<!\d)(?:\+?84|0)(?:3[2-9]|5[6-9]|7[06-9]|8[1-9]|9[0-46-9])\d{7}(?!\d)"),
    ("URL", r"https?://[^\s<>\"]+"),
    ("IP", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("ACCOUNT", r"(?<!\d)\d{8,14}(?!\d)"),
    ("ID_NUMBER", r"(?<!\d)\d{9}(?:\d{3})?(?!\d)"),
)
TYPE_SIGNATURES = (
    ("research_paper", (r"(?im)^#\s*Abstract", r"(?im)##\s*\d+\s*Introduction", r"(?i)\barXiv:\d{4}\.\d{4,5}", r"(?i)\bReferences\s*\[\d+\]")),
    ("report_financial", (r"(?i)\b(doanh thu|revenue|EBITDA|gross profit|net income)\b", r"(?i)\b(Q[1-4]\s+\d{4}|quý\s+[1-4])\b", r"(?i)\d+\.\d+\s+(tỷ|triệu|million|billion)")),
    ("chat_log", (r'(?i)"role"\s*:\s*"(user|assistant|system)"', r"(?m)^\[\d{2}:\d{2}\]", r"(?m)^@\w+:")),
    ("legal_contract", (r"(?i)\b(Điều|Article|Section)\s+\d+", r"(?i)\b(bên A|bên B|party A|party B|whereas|hereby)\b", r"(?i)\b(hợp đồng|contract|agreement)\s+số")),
    ("code", (r"(?m)^(def|class|function|public|private)\s+\w+", r"(?m)^```(python|javascript|java|cpp|go|rust)", r"(?m)^(import|from|require|use)\s+")),
)
TYPE_NEEDS = {
    r"(?im)^#\s*Abstract": "#", r"(?im)##\s*\d+\s*Introduction": "##", r"(?i)\barXiv:\d{4}\.\d{4,5}": ":", r"(?i)\bReferences\s*\[\d+\]": "[",
    r'(?i)"role"\s*:\s*"(user|assistant|system)"': '"', r"(?m)^\[\d{2}:\d{2}\]": "[", r"(?m)^@\w+:": "@", r"(?i)\b(hợp đồng|contract|agreement)\s+số": "ố",
    r"(?m)^```(python|javascript|java|cpp|go|rust)": "```",
}
"""What a head that matches the pattern cannot do without."""
TYPE_NAMES = (
    ("legal_contract", ("contract", "agreement", "hợp đồng", "legal")),
    ("chat_log", ("chat", "conversation", "log", "messages")),
    ("report_financial", ("financial", "earnings", "quarterly", "doanh-thu")),
)
TYPE_SIZES = {
    "research_paper": (800, 0.55), "report_financial": (600, 0.50), "chat_log": (300, 0.40),
    "legal_contract": (1200, 0.70), "code": (500, 0.60), "generic": (800, 0.55),
}

ADDRESS = r"(?:https?://|www[.\x00])\S+"
NO_FRAGMENT = (r"(?i)^\s*(figure|table)\s*\d+", r"^\s*\d+(?:\.\d+)?\s*[A-Z][\w\s]{0,40}\s*$")
STRUCTURAL = (r"^#{1,6}\s", r"^[-*+]\s", r"^\d+\.\s")
PAGE_ARTIFACTS = (r"\n\s*\d{1,4}\s*$", r"(?i)\n\s*Page\s+\d+\s+of\s+\d+\s*$", r"(?i)\n\s*Preprint\.?\s*$")
ENTITY_TOKEN = r"\b[A-Z][A-Za-z0-9\-]{1,30}\b"
ACRONYMS = {
    "PPR": "Personalized PageRank", "RAG": "Retrieval-Augmented Generation", "GraphRAG": "Graph-based Retrieval-Augmented Generation", "KG": "Knowledge Graph",
    "LLM": "Large Language Model", "NER": "Named Entity Recognition", "BGE": "BAAI General Embedding", "HyDE": "Hypothetical Document Embeddings",
    "CoT": "Chain of Thought", "ReAct": "Reasoning and Acting", "MMR": "Maximal Marginal Relevance", "TF-IDF": "Term Frequency Inverse Document Frequency",
    "KNN": "K-Nearest Neighbors", "HNSW": "Hierarchical Navigable Small World", "MIPS": "Maximum Inner Product Search", "BM25": "Best Matching 25",
    "QA": "Question Answering", "API": "Application Programming Interface", "PII": "Personally Identifiable Information", "OOD": "Out of Distribution",
    "OOV": "Out of Vocabulary", "MLM": "Masked Language Modeling", "MoE": "Mixture of Experts", "GNN": "Graph Neural Network",
    "RAGAS": "Retrieval Augmented Generation Assessment", "PEFT": "Parameter-Efficient Fine-Tuning", "LoRA": "Low-Rank Adaptation",
    "DPR": "Dense Passage Retrieval", "ANN": "Approximate Nearest Neighbor", "FAISS": "Facebook AI Similarity Search",
}
ENTITY_NAME = r"[A-ZĐ][\w\-]+(?:\s+[A-ZĐ][\w\-]+)?"
COMPARISONS = (
    rf"so sánh\s+({ENTITY_NAME})\s+(?:và|vs|với)\s+({ENTITY_NAME})(?=[\s\?\.,;:]|$)",
    rf"({ENTITY_NAME})\s+(?:cải thiện|cải tiến|.+?)?\s*so với\s+({ENTITY_NAME})(?=[\s\?\.,;:]|$)",
    rf"\b({ENTITY_NAME})\s+vs\s+({ENTITY_NAME})\b",
    rf"({ENTITY_NAME})\s+và\s+({ENTITY_NAME})\s+khác",
    rf"\b({ENTITY_NAME})\s+và\s+({ENTITY_NAME})\s+(?:trong|về|cho|đối với|có gì)",
)
TRAILING_WORDS = (
    "cải", "thiện", "tiến", "về", "trong", "trên", "cho", "tại", "theo", "đối", "với", "có", "là", "nào", "khác", "nhau", "tốt", "hơn",
    "phương", "pháp", "hệ", "thống", "mô", "hình", "model", "method", "system", "approach", "the", "a", "an",
)
NO_ENTITIES = ("rag", "system", "method", "approach", "model", "paper", "phương pháp", "hệ thống", "mô hình")

SPACE = r"[\s]+"
TRIM = r"^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, TRIM, "")


def any_of(text: Column, patterns, flags: str = "(?iu)") -> Column:
    return text.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def count_of(text: Column, patterns, flags: str = "(?iuU)") -> Column:
    """Matches of each pattern, summed; patterns are counted one by one, as they may overlap."""
    total = F.lit(0)
    for p in patterns:
        total = total + F.regexp_count(text, F.lit(flags + p))
    return total


def has_any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, SPACE), ""))


def sanitize_name(name: Column) -> Column:
    """One space for white space, an underscore for what is no word character, space or hyphen; 200 characters."""
    return F.substring(F.regexp_replace(strip(F.regexp_replace(name, SPACE, " ")), r"(?U)[^\w\s\-]", "_"), 1, 200)


def clean_span(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, SPACE, " "), r"^[\s\"'“”‘’()\[\]{}.,;:!?]+|[\s\"'“”‘’()\[\]{}.,;:!?]+$", "")


def normal_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[\s_]+", ""))


def skeleton(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^0-9a-z]", "")


def same_skeleton(a: Column, b: Column) -> Column:
    return (skeleton(a) == skeleton(b)) & (skeleton(a) != "")


def initials(name: Column) -> Column:
    words = F.filter(F.split(F.lower(name), r"[^0-9a-z]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def lexically_related(a: Column, b: Column) -> Column:
    """One skeleton holds the other (4 characters at least, 80 % of the longer), or one is the other's initials."""
    x, y = skeleton(a), skeleton(b)
    shorter = F.when(F.length(x) <= F.length(y), x).otherwise(y)
    longer = F.when(F.length(x) <= F.length(y), y).otherwise(x)
    holds = (F.length(shorter) >= 4) & (F.length(shorter) * 5 >= F.length(longer) * 4) & longer.contains(shorter)
    short = lambda s, other: (F.length(s) >= 2) & (s == initials(other)) & (F.size(F.split(strip(other), SPACE)) >= 2)
    return F.coalesce(holds | short(x, b) | short(y, a), F.lit(False))


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def replace_matches(text: Column, pattern: str, change) -> Column:
    """The text with change(match) in place of every match of a pattern without groups that matter."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rest = lambda i: F.get(F.split(text, pattern, -1), i)
    after = F.zip_with(F.transform(found, change), F.slice(F.split(text, pattern, -1), 2, F.greatest(F.size(found), F.lit(1))), lambda m, r: F.concat(m, r))
    return F.when(F.size(found) == 0, text).otherwise(F.concat(rest(F.lit(0)), F.array_join(after, "")))


MARK = "<(?:" + "|".join(kind for kind, _ in MASKS) + ")_[0-9a-f]{8}>"


def masked(text: Column) -> Column:
    """Struct (text, values): personal values replaced kind by kind, each by its pattern, and the array of
    (kind, value, mark) that went. Marks already placed are left alone by later kinds."""
    out = F.struct(text.alias("text"), F.array().cast("array<struct<kind: string, value: string, mark: string>>").alias("values"))
    for kind, pattern in MASKS:
        out = let(out, _masking(kind, pattern))
    return out


def _masking(kind: str, pattern: str):
    placed, either = f"^{MARK}$", f"{MARK}|{pattern}"
    made = lambda v: F.concat(F.lit(f"<{kind}_"), F.substring(F.sha2(v, 256), 1, 8), F.lit(">"))

    def step(s: Column) -> Column:
        found = F.filter(F.array_distinct(F.regexp_extract_all(s["text"], F.lit(either), F.lit(0))), lambda v: ~v.rlike(placed))
        marks = F.transform(found, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), made(v).alias("mark")))
        replaced = replace_matches(s["text"], either, lambda m: F.when(m.rlike(placed), m).otherwise(made(m)))
        return F.struct(F.when(s["text"].rlike(pattern), replaced).otherwise(s["text"]).alias("text"), F.concat(s["values"], marks).alias("values"))

    return step


def mask_values(text: Column) -> Column:
    """Array of (kind, value, mark) of all personal values, in the order in which kinds are masked."""
    return masked(text)["values"]


def mask(text: Column, values: Column | None = None) -> Column:
    """The text with each personal value replaced by its mark; ``values`` are found by the same patterns and not needed."""
    return masked(text)["text"]


def unmask(text: Column, values: Column) -> Column:
    return F.aggregate(values, text, lambda t, v: F.replace(t, v["mark"], v["value"]))


def sentences(text: Column) -> Column:
    """Sentences; dots of abbreviations, numbers, addresses and initials end none."""
    dot = "\u0000"
    out = strip(text)
    initial = "".join(sorted({a[0] for a in ABBREVIATIONS}))  # looked for first, as word ends are slow to tell
    out = F.regexp_replace(out, rf"(?U)(?=[{initial}])\b(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\.", "$1" + dot)
    out = F.regexp_replace(out, r"(?<=\d)\.(?=\d)", dot)
    whole = lambda t: F.when(t.rlike(ADDRESS), replace_matches(t, ADDRESS, lambda m: F.replace(m, F.lit("."), F.lit(dot)))).otherwise(t)
    out = let(out, whole)  # all dots of an address, its last one too
    out = F.regexp_replace(out, r"\b([A-Z])\.(?=\s+[A-Z])", "$1" + dot)
    cut = F.split(out, r"(?<=[.!?])\s+(?=[A-ZÀ-Ỹ])")
    return F.filter(F.transform(cut, lambda s: F.replace(s, F.lit(dot), F.lit("."))), lambda s: s != "")  # no white space is left at a cut


def strip_artifacts(text: Column) -> Column:
    """Without up to three page numbers, page counts or running heads at the end."""
    out = F.regexp_replace(text, r"\s+$", "")
    for _ in range(3):
        for pattern in PAGE_ARTIFACTS:
            out = F.regexp_replace(out, pattern, "")
    return out


def is_refusal(answer: Column) -> Column:
    return (F.length(strip(answer)) < 200) & any_of(F.lower(answer), REFUSALS)


def citation_ratio(answer: Column) -> Column:
    """Share of sentences of more than ten characters with a citation; 1 for refusals and where there are none."""
    parts = F.filter(F.transform(F.split(answer, r"(?<=[.!?])\s+"), strip), lambda s: F.length(s) > 10)
    cited = F.filter(parts, lambda s: s.rlike(CITATION) | s.rlike(CITATION_PATH))
    return F.when(is_refusal(answer) | (F.size(parts) == 0), F.lit(1.0)).otherwise(F.size(cited) / F.size(parts))


def title_entities(text: Column) -> Column:
    spans = F.regexp_extract_all(text, F.lit(r"(?U)(?=\p{Lu})\b(\p{Lu}[\w]+(?:\s+\p{Lu}[\w]+){0,4})\b"), F.lit(1))
    return F.array_distinct(F.filter(spans, lambda s: F.length(s) > 3))


def entity_tokens(query: Column) -> Column:
    tokens = F.regexp_extract_all(query, F.lit(ENTITY_TOKEN), F.lit(0))
    return F.size(F.filter(tokens, lambda t: ~t.isin(*SENTENCE_STARTERS)))


def expand_acronyms(text: Column, expansions: dict[str, str]) -> Column:
    """Each acronym, as a whole word, becomes its expansion; in the order given."""
    for short, long in expansions.items():
        text = F.regexp_replace(text, rf"(?U)\b{re.escape(short)}\b", long)
    return text


def comparative_spans(query: Column) -> Column:
    """The two names of a comparison by the first pattern that fits; words that end no name are cut, and short, long or
    general names left out."""
    hit = lambda p: F.array(*[F.regexp_extract(query, "(?iuU)" + p, k) for k in (1, 2)])
    found = F.array().cast("array<string>")
    for p in reversed(COMPARISONS):
        found = F.when(query.rlike("(?iuU)" + p), hit(p)).otherwise(found)
    tail = r"(?iuU)(?:(?:^|\s+)(?:" + "|".join(TRAILING_WORDS) + r"))+$"
    clean = F.transform(found, lambda x: strip(F.regexp_replace(F.regexp_replace(strip(x), r"^[\s.,;:?!]+|[\s.,;:?!]+$", ""), tail, "")))
    kept = F.filter(clean, lambda x: (F.length(x) > 2) & (F.length(x) < 60) & ~F.lower(x).isin(*NO_ENTITIES))
    return F.when((F.size(kept) == 2) & (F.lower(F.get(kept, 0)) == F.lower(F.get(kept, 1))), F.slice(kept, 1, 1)).otherwise(kept)


def keyword_score(text: Column, weights: dict[str, float]) -> Column:
    return lower_score(F.lower(text), weights)


def lower_score(low: Column, weights: dict[str, float]) -> Column:
    """``keyword_score`` of a text in lower case."""
    total = F.lit(0.0)
    for word, weight in weights.items():
        total = total + F.when(low.contains(word), F.lit(float(weight))).otherwise(F.lit(0.0))
    return total


def quality(text: Column, entity_count: Column) -> Column:
    """Struct (overall, density, has_structure, hedges, promotion, drafts, accept) of one chunk."""
    body = strip(text)
    size, words = F.length(body), F.greatest(word_count(body), F.lit(1))
    density, hedges, promotion, drafts = entity_count / words, count_of(body, HEDGES), count_of(body, PROMOTION), count_of(body, DRAFTS)
    structure = body.rlike(STRUCTURE[0]) | body.rlike(STRUCTURE[1]) | body.rlike(STRUCTURE[2])
    ratio = hedges / words
    score = (
        F.lit(1.0)
        - F.when(size < 50, 0.5).when(size > 5000, 0.2).otherwise(0.0)
        + F.when((density < 0.005) & (size > 200), -0.15).when(density > 0.05, 0.05).otherwise(0.0)
        + F.when(structure, 0.10).when(size < 100, -0.10).otherwise(0.0)
        - F.when(ratio > 0.05, F.least(F.lit(0.3), ratio * 2)).otherwise(0.0)
        - F.when(promotion > 2, 0.2).otherwise(0.0)
        - F.when(drafts > 0, 0.5).otherwise(0.0)
    )
    overall = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)
    return F.struct(
        overall.alias("overall"), F.round(density, 6).alias("density"), structure.alias("has_structure"), hedges.alias("hedges"),
        promotion.alias("promotion"), drafts.alias("drafts"), (overall >= 0.4).alias("accept"),
    )


def is_fragment(text: Column) -> Column:
    body = strip(F.coalesce(text, F.lit("")))
    return (F.length(body) < 80) | body.rlike(NO_FRAGMENT[0]) | body.rlike(NO_FRAGMENT[1])


def out_of_domain(query: Column) -> Column:
    return any_of(strip(query), OUT_OF_DOMAIN)


def corpus_wide(query: Column) -> Column:
    return any_of(strip(query), CORPUS_WIDE)


def rule_intent(query: Column) -> Column:
    out = F.lit("factual")
    for intent, words in reversed(INTENT_KEYWORDS):
        out = F.when(has_any(F.lower(query), words), F.lit(intent)).otherwise(out)
    return out


def chat_intent(query: Column) -> Column:
    """Struct (intent, confidence) of a chat message."""
    q = strip(query)
    answer = lambda i, c: F.struct(F.lit(i).alias("intent"), F.lit(c).alias("confidence"))
    return (
        F.when(q == "", answer("greeting", 1.0))
        .when(q.rlike(GREETING), answer("greeting", 0.95))
        .when(q.rlike(FOLLOW_UP) & (word_count(q) < 12), answer("follow_up", 0.75))
        .when(q.rlike(QUESTION), answer("question", 0.85))
        .otherwise(answer("question", 0.6))
    )


def needs_reasoning(intent: Column, query: Column) -> Column:
    signals = (F.length(query) >= 60) | (entity_tokens(query) >= 2) | has_any(F.lower(query), REASONING_KEYWORDS)
    return intent.isin(*REASONING_INTENTS) & signals


def mode(text: Column) -> Column:
    out = F.lit("NARRATIVE")
    for name, patterns in reversed(MODES):
        out = F.when(text.rlike(MODE_HINTS[name]) & any_of(text, patterns, "(?iuU)"), F.lit(name)).otherwise(out)
    return out


def structural(text: Column) -> Column:
    return structural_bare(strip(text))


def structural_bare(body: Column) -> Column:
    """``structural`` of a text without white space around it."""
    return (body == "") | body.rlike(r"^(?:" + "|".join(p.removeprefix("^") for p in STRUCTURAL) + ")") | body.startswith("```")


def discourse(text: Column) -> Column:
    return F.substring(text, 1, 50).rlike(r"(?iuU)\b(?:" + "|".join(DISCOURSE) + r")\b")


def doc_type(text: Column, filename: Column) -> Column:
    name = F.lower(filename)

    def voted(head: Column) -> Column:
        needs = lambda p: head.contains(TYPE_NEEDS[p]) & head.rlike(p) if p in TYPE_NEEDS else head.rlike(p)
        return F.array(*[sum((needs(p).cast("int") for p in patterns), F.lit(0)) for _, patterns in TYPE_SIGNATURES])

    votes = let(F.substring(text, 1, 3000), voted)
    first = F.transform(F.array(votes), lambda v: F.when(F.array_max(v) >= 2, F.array_position(v, F.array_max(v))).otherwise(0))
    kinds = F.array(F.lit("generic"), *[F.lit(kind) for kind, _ in TYPE_SIGNATURES])
    by_vote = F.element_at(kinds, (F.element_at(first, 1) + 1).cast("int"))
    out = F.when(name.rlike(r"\.(py|js|ts|java|cpp|go|rs)$"), F.lit("code")).otherwise(by_vote)
    for kind, words in reversed(TYPE_NAMES):
        out = F.when(has_any(name, words), F.lit(kind)).otherwise(out)
    return out


def model_json(text: Column, schema: str) -> Column:
    """The first {...} of a model's answer, code fences removed, parsed; null where there is none."""
    return F.from_json(F.regexp_extract(F.regexp_replace(text, "```(?:json)?", ""), r"(?s)\{.*\}", 0), schema)
