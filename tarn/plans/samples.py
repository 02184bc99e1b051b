"""A corpus profile for the registered queries, in the words of the synthetic documents."""

from __future__ import annotations

from tarn.operators.profile import Profile

PROFILE = Profile.of(
    {
        "name": "Synthetic corpus",
        "summary": "the of and with thereon",
        "coverage": "passages on blend, anon and orange",
        "non_coverage": "weather forecast idiot pathetic",
        "usage_notes": "ask in one sentence",
        "domain_keywords": ["anin", "erst", "the blend", "Orin"],
        "primary_entities": ["Thand", "onthe", "eating"],
        "forbidden_questions": ["stupid loser", "worthless"],
        "recommended_questions": ["what is the blend"],
        "preferred_answer_style": "short",
    }
)
