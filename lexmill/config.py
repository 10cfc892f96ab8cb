"""Settings of the retrieval pipeline; every value can be set by an environment variable LEXMILL_<NAME>."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

# Word lists, markers and figures that results depend on.
STOP_WORDS = """and or the for to of in an a is on at by from as if you your how what when it are be do has have this that with
not can may will about more our we us its""".split()
HEADING_STOP_WORDS = "and or the for to of in an a is you your how what when if on at by".split()
BOILERPLATE = [
    "BEGIN NOINDEX",
    "END NOINDEX",
    "Skip to main content",
    "Skip To search",
    "Report webpage issue",
    "Print or Download",
]
NOISE_HEADINGS = [
    "on this page",
    "tools",
    "help and support",
    "our commitment to you",
    "copyright notice",
    "individuals",
    "business",
    "agents",
]
QUICK_CODE = r"\bQC\s*\d+\b"
LAST_UPDATED = r"Last updated\s*\d+\s*\w+\s*\d{4}"
#: Guides for single occupations, words that ask for them, and general pages, as scores are adjusted by them.
NARROW_PATHS = ["/guides-for-occupations-and-industries/"]
NARROW_TERMS = """nurse doctor teacher driver pilot engineer mechanic builder electrician plumber police army adf military lawyer
accountant mining farm chef hospitality retail security guard firefighter paramedic dentist surgeon tradesperson carpenter
painter""".split()
BROAD_PATHS = [
    "/deductions-you-can-claim/",
    "/work-related-deductions/",
    "/working-from-home",
    "/clothing",
    "/self-education",
    "/cars-transport",
    "/phone-internet",
]
PREP_BOILERPLATE = ["Skip to main content", "BEGIN NOINDEX", "Report webpage issue"]


@dataclass(frozen=True)
class Settings:
    retriever_topk: int = 40
    rerank_cap: int = 15
    final_topk: int = 5
    max_per_url: int = 2
    mmr_lambda: float = 0.30
    rrf_k: int = 60
    dense_weight: float = 0.6
    sparse_weight: float = 0.4
    reranker_weight: float = 0.70
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    chunk_max_tokens: int = 384
    chunk_min_tokens: int = 60
    branch_cap: int = 50
    title_boost: float = 0.003
    title_boost_one: float = 0.001
    path_penalty: float = 0.004
    path_boost: float = 0.001

    @classmethod
    def from_env(cls) -> Settings:
        given = {f.name: os.environ.get(f"LEXMILL_{f.name.upper()}") for f in fields(cls)}
        return cls(**{k: type(getattr(cls, k))(v) for k, v in given.items() if v is not None})
