"""Corpus profiles: what a corpus covers, as a record, and the checks and hints that follow for queries.

A profile is small and lives on the driver; its term lists become literals of the expressions.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import text as T

# The most entries of each list.
LIMITS = {"source_examples": 10, "recommended_questions": 12, "forbidden_questions": 12, "domain_keywords": 20, "primary_entities": 20}


def folded(s: str) -> str:
    return s.lower().replace("ß", "ss")


def term_list(s: str) -> list[str]:
    """The distinct terms of a text, as ``functions.text.terms`` finds them."""
    apart = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", s)
    return list(dict.fromkeys(folded(w) for w in re.findall(r"\w+", apart)))


def compacted(s: str) -> str:
    return folded(re.sub(r"[\W_]+", "", s))


def clean_list(values: Any, limit: int) -> list[str]:
    """Stripped entries, the first of each by folded text; a string is a list of one, anything else is empty."""
    values = [values] if isinstance(values, str) else values
    out: dict[str, str] = {}
    for v in values if isinstance(values, list) else []:
        s = str(v).strip()
        if s and len(out) < limit:
            out.setdefault(folded(s), s)
    return list(out.values())


@dataclass(frozen=True)
class Profile:
    name: str = ""
    summary: str = ""
    coverage: str = ""
    non_coverage: str = ""
    usage_notes: str = ""
    preferred_answer_style: str = ""
    source_examples: list[str] = field(default_factory=list)
    recommended_questions: list[str] = field(default_factory=list)
    forbidden_questions: list[str] = field(default_factory=list)
    domain_keywords: list[str] = field(default_factory=list)
    primary_entities: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, raw: dict[str, Any] | None) -> Profile:
        """From any record: missing fields are empty, texts are stripped, lists cleaned and limited."""
        raw = raw if isinstance(raw, dict) else {}
        return cls(**{n: clean_list(raw.get(n, []), LIMITS[n]) if n in LIMITS else str(raw.get(n, "") or "").strip() for n in cls.__dataclass_fields__})

    def terms(self, *names: str) -> list[str]:
        parts: list[str] = []
        for n in names:
            v = getattr(self, n)
            parts += v if isinstance(v, list) else [v]
        return term_list(" ".join(parts))

    def covered(self) -> list[str]:
        return self.terms("name", "summary", "coverage", "usage_notes", "domain_keywords", "primary_entities")

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    def described(self) -> str:
        """The record in English lines, for a model's prompt; lists cut to what a prompt should hold."""
        if not any(asdict(self).values()):
            return "No corpus profile is available."
        return self._lines(PROMPT_LINES)

    def displayed(self) -> str:
        """The record in Chinese lines, for people; lists whole."""
        return self._lines(DISPLAY_LINES)

    def _lines(self, rows: list[tuple[str, str, str, str, int]]) -> str:
        out = []
        for name, label, empty, sep, limit in rows:
            value = getattr(self, name)
            out.append(f"{label}: {(sep.join(value[:limit]) if isinstance(value, list) else value) or empty}")
        return "\n".join(out)


# Field, label, text where it is empty, separator, entries shown.
PROMPT_LINES = [
    ("name", "Knowledge Base Name", "Unnamed knowledge base", "", 0),
    ("summary", "Summary", "Not provided", "", 0),
    ("coverage", "Coverage", "Not provided", "", 0),
    ("non_coverage", "Non-Coverage", "Not provided", "", 0),
    ("usage_notes", "Usage Notes", "Not provided", "", 0),
    ("source_examples", "Representative Sources", "None listed", ", ", 10),
    ("recommended_questions", "Recommended Questions", "None listed", "; ", 8),
    ("forbidden_questions", "Forbidden Questions", "None listed", "; ", 8),
    ("domain_keywords", "Domain Keywords", "None listed", ", ", 12),
    ("primary_entities", "Primary Entities", "None listed", ", ", 12),
    ("preferred_answer_style", "Preferred Answer Style", "Not provided", "", 0),
]
DISPLAY_LINES = [
    ("name", "知识库名称", "未命名知识库", "", 0),
    ("summary", "内容摘要", "未填写", "", 0),
    ("coverage", "覆盖范围", "未填写", "", 0),
    ("non_coverage", "不覆盖范围", "未填写", "", 0),
    ("usage_notes", "使用说明", "未填写", "", 0),
    ("recommended_questions", "推荐提问", "暂无", "; ", 12),
    ("forbidden_questions", "禁止/不建议问题", "暂无", "; ", 12),
    ("domain_keywords", "领域关键词", "暂无", ", ", 20),
    ("primary_entities", "核心实体", "暂无", ", ", 20),
    ("preferred_answer_style", "偏好回答风格", "未填写", "", 0),
    ("source_examples", "代表性文件", "暂无", ", ", 10),
]


def matches(query: Column, terms: Column, phrases: list[str], least: int = 1, inside: bool = True) -> Column:
    """The phrases that share enough terms with the query or, if ``inside``, that contain it or lie in it as bare letters."""
    found = []
    bare = T.compact(query)
    for p in phrases:
        own = term_list(p)
        hit = F.lit(False)
        if own:
            hit = F.size(F.array_intersect(terms, F.array(*map(F.lit, own)))) >= max(1, min(least, len(own)))
        if inside and (c := compacted(p)):
            hit = hit | ((bare != "") & (F.contains(bare, F.lit(c)) | F.contains(F.lit(c), bare)))
        found.append(F.when(hit & (F.size(terms) > 0), F.lit(p)))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def scoped(queries: DataFrame, profile: Profile, text: str = "query") -> DataFrame:
    """Adds the matched lists, ``coverage_overlap``, ``out_of_scope`` and ``reason`` to each query.

    Out of scope: a forbidden question matches, or the uncovered field does while nothing covered is shared. One shared
    term with a forbidden question is enough; the uncovered field needs two.
    """
    q = T.strip(F.coalesce(F.col(text), F.lit("")))
    out = queries.withColumn("_t", T.terms(q))
    t = F.col("_t")
    covered = profile.terms("name", "summary", "coverage", "usage_notes", "domain_keywords", "primary_entities", "recommended_questions")
    none = F.array().cast("array<string>")
    out = out.withColumns(
        {
            "matched_keywords": matches(q, t, profile.domain_keywords),
            "matched_entities": matches(q, t, profile.primary_entities),
            "matched_non_coverage": matches(q, t, [profile.non_coverage] if profile.non_coverage else [], 2, False),
            "matched_forbidden": matches(q, t, profile.forbidden_questions),
            "coverage_overlap": F.size(F.array_intersect(t, F.array(*map(F.lit, covered)) if covered else none)),
        }
    )
    has = lambda c: F.size(c) > 0
    out = out.withColumn("out_of_scope", has("matched_forbidden") | (has("matched_non_coverage") & (F.col("coverage_overlap") == 0) & ~has("matched_keywords") & ~has("matched_entities")))
    part = lambda label, c: F.when(has(c), F.concat(F.lit(label), F.array_join(F.slice(c, 1, 3), ", ")))
    last = F.coalesce(part("matched forbidden topics: ", "matched_forbidden"), part("matched non-coverage topics: ", "matched_non_coverage"))
    reason = F.concat_ws("; ", part("matched domain keywords: ", "matched_keywords"), part("matched primary entities: ", "matched_entities"), last)
    return out.withColumn("reason", reason).drop("_t")


def _with_terms(query: Column, guidance: Column) -> Column:
    """The query with the first two guiding terms that it lacks behind it."""
    missing = F.slice(F.filter(guidance, lambda g: ~F.contains(T.fold(query), T.fold(g))), 1, 2)
    return F.when(F.size(missing) > 0, T.strip(F.concat(query, F.lit(" "), F.array_join(missing, " ")))).otherwise(query)


def with_prior(planned: DataFrame, text: str = "query") -> DataFrame:
    """Scoped plans: up to two entities and two keywords guide each subquery; a matched entity asks for paragraphs too."""
    guidance = F.concat(F.slice("matched_entities", 1, 2), F.slice("matched_keywords", 1, 2))
    subs = T.distinct_list(F.coalesce("subqueries", F.array().cast("array<string>")), 3)
    subs = F.when(F.size(subs) > 0, subs).otherwise(F.array(T.strip(F.col(text))))
    kinds = T.distinct_list(F.coalesce("node_types", F.array().cast("array<string>")), 3)
    kinds = F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.lit("paragraph")))
    more = (F.size("matched_entities") > 0) & ~F.array_contains(kinds, "paragraph")
    return planned.withColumns(
        {
            "subqueries": F.slice(F.transform(subs, lambda s: _with_terms(s, guidance)), 1, 3),
            "node_types": F.slice(F.when(more, F.concat(kinds, F.array(F.lit("paragraph")))).otherwise(kinds), 1, 3),
            "hint_keywords": F.slice("matched_keywords", 1, 3),
            "hint_entities": F.slice("matched_entities", 1, 3),
        }
    )


def expanded(rewritten: DataFrame, queries: str = "queries") -> DataFrame:
    """Scoped rows with a list of queries: guided variants are added until there are three; three originals leave no room."""
    base = T.distinct_list(F.col(queries), 6)
    hints = [F.col(c) for c in ("hint_entities", "hint_keywords") if c in rewritten.columns]
    guidance = T.distinct_list(F.concat("matched_entities", "matched_keywords", *hints), 4)
    guided = F.filter(F.transform(base, lambda q: _with_terms(q, guidance)), lambda q: ~F.array_contains(base, q))
    return rewritten.withColumn(queries, F.when(F.size(guidance) == 0, F.slice(base, 1, 3)).otherwise(T.distinct_list(F.concat(base, guided), 3)))
