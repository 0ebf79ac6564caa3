"""Settings: defaults, a YAML file, then environment variables."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from typing import Any

ENV_PREFIX = "CITELUME_"


# fixed values: names and defaults that decide results
@dataclass(frozen=True)
class Settings:
    # chunks and retrieval sizes
    chunk_size_tokens: int = 700
    chunk_overlap_tokens: int = 120
    top_k: int = 8
    retrieve_candidates: int = 24
    dense_top_k: int = 24
    sparse_top_k: int = 24
    fusion_rrf_k: int = 60
    # quality of chunks
    reference_detection_enabled: bool = True
    exclude_reference_chunks: bool = True
    reference_exclusion_threshold: float = 0.72
    post_chunk_trim_reference_tails: bool = True
    exclude_references: bool = True
    metadata_enrichment_enabled: bool = True
    generate_chunk_summary: bool = False
    # ranking
    bm25_enabled: bool = True
    reranker_enabled: bool = False
    reranker_top_n: int = 12
    query_expansion_enabled: bool = True
    dense_score_weight: float = 0.24
    sparse_score_weight: float = 0.16
    direct_defect_match_weight: float = 0.2
    mitigation_signal_weight: float = 0.16
    parameter_relation_weight: float = 0.14
    experimental_evidence_weight: float = 0.12
    mechanism_signal_weight: float = 0.1
    material_process_match_weight: float = 0.1
    evidence_directness_weight: float = 0.12
    reference_penalty_weight: float = 0.45
    generic_background_penalty_weight: float = 0.08
    section_boosts: tuple[tuple[str, float], ...] = (("results", 0.08), ("discussion", 0.08), ("conclusions", 0.05), ("recommendations", 0.09), ("abstract", -0.03), ("introduction", -0.02))
    default_process_terms: tuple[str, ...] = ("WAAM", "wire arc additive manufacturing", "arc additive manufacturing", "welding", "process monitoring", "quality control")
    citation_style: str = "author_year_pages"
    # vectors
    embedding_backend: str = "hashing"
    embedding_dims: int = 1024
    # splits a page's text into paragraphs
    paragraph_break: str = r"\n{2,}"
    storage_dir: str = "data"


def env_value(text: str) -> Any:
    """A variable's value: boolean, null, comma list, JSON, integer, float, else text, in this order."""
    low = text.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("null", "none", ""):
        return None
    if "," in text and text.strip()[0] not in "[{":
        return [part.strip() for part in text.split(",") if part.strip()]
    for parse in (json.loads, int, float):
        try:
            return parse(text)
        except ValueError:
            continue
    return text


def _shaped(name: str, value: Any) -> Any:
    if name == "section_boosts" and isinstance(value, Mapping):
        return tuple((str(k), float(v)) for k, v in value.items())
    return tuple(value) if isinstance(value, list) else value


def load_settings(path: str | None = None, environment: Mapping[str, str] | None = None) -> Settings:
    """Defaults, overridden by the file's mapping, overridden by CITELUME_<NAME>; unknown names raise ValueError."""
    values: dict[str, Any] = {}
    if path:
        try:
            import yaml

            with open(path) as f:
                values = yaml.safe_load(f) or {}
        except ModuleNotFoundError:  # JSON is YAML
            with open(path) as f:
                values = json.load(f)
        if not isinstance(values, dict):
            raise ValueError(f"{path} holds no mapping")
    known = {f.name for f in fields(Settings)}
    for key, text in (os.environ if environment is None else environment).items():
        if key.startswith(ENV_PREFIX) and (name := key[len(ENV_PREFIX) :].lower()) in known:
            values[name] = env_value(text)
    if unknown := sorted(set(values) - known):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return replace(Settings(), **{k: _shaped(k, v) for k, v in values.items() if v is not None})
