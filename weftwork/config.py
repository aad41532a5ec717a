"""Configuration: frozen dataclasses, read from a folder of YAML files or built in code.

A folder holds pipeline.yaml, merge_rules.yaml, normalization.yaml, projection.yaml,
source_reliability.yaml and entity_resolution.yaml. A missing file means that part's defaults without
any rules: no field rules (so lists take the first non-empty one by the default priority), no synonyms
and no projected fields. ``standard()`` is the full configuration the engine ships with.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, is_dataclass, replace
from functools import lru_cache
from typing import Any

STRATEGIES = ("priority", "most_complete", "union")
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")

# Weights, thresholds and rules that results depend on.

RELIABILITY = {"csv": 0.70, "json": 0.75, "resume_pdf": 0.85, "linkedin": 0.90, "github": 0.80, "ats": 0.95}
STANDARD_RELIABILITY = {"ats": 0.95, "linkedin": 0.90, "resume_pdf": 0.85, "github": 0.80, "json": 0.75, "csv": 0.70, "unknown": 0.40}
DEFAULT_PRIORITY = ("ats", "resume_pdf", "linkedin", "json", "csv")
STANDARD_RULES = {
    "name": ("priority", ("resume_pdf", "linkedin", "ats", "json", "csv")),
    "email": ("priority", ("csv", "json", "ats", "resume_pdf", "linkedin")),
    "phone": ("most_complete", ("csv", "resume_pdf", "json", "linkedin", "ats")),
    "location": ("priority", ("linkedin", "resume_pdf", "ats", "json", "csv")),
    "summary": ("most_complete", ("resume_pdf", "linkedin", "json", "csv")),
    "skills": ("union", ("resume_pdf", "linkedin", "ats", "json", "csv")),
    "experience": ("union", ("resume_pdf", "linkedin", "ats")),
    "education": ("union", ("resume_pdf", "linkedin", "ats")),
    "links": ("union", ("linkedin", "github", "resume_pdf", "csv", "json")),
}
STANDARD_SYNONYMS = {
    "Machine Learning": ["ML", "machine learning", "machine-learning", "MachineLearning"],
    "Deep Learning": ["DL", "deep learning", "deep-learning"],
    "Natural Language Processing": ["NLP", "natural language processing", "nlp"],
    "Python": ["python3", "python 3", "py"],
    "JavaScript": ["JS", "js", "javascript"],
    "TypeScript": ["TS", "ts", "typescript"],
    "React": ["ReactJS", "React.js", "react"],
    "Node.js": ["NodeJS", "Node", "nodejs"],
    "PostgreSQL": ["Postgres", "postgres", "postgresql"],
    "Amazon Web Services": ["AWS", "aws"],
    "Google Cloud Platform": ["GCP", "gcp", "Google Cloud"],
    "Microsoft Azure": ["Azure", "azure"],
    "Kubernetes": ["K8s", "k8s"],
    "Docker": ["docker", "Docker Container"],
    "Continuous Integration": ["CI", "ci", "CI/CD", "cicd"],
}
STANDARD_PROJECTION = {
    "name": "full_name", "email": "email_address", "phone": "phone_number", "location": "location", "summary": "professional_summary",
    "skills": "skills", "experience": "work_experience", "education": "education", "links": "links",
}
FIELD_WEIGHTS = {"name": 0.10, "email": 0.08, "phone": 0.07, "location": 0.0, "summary": 0.0, "skills": 0.20, "experience": 0.30, "education": 0.20, "links": 0.05}
LIST_FIELDS = ("skills", "experience", "education", "links")


class ConfigError(ValueError):
    pass


def _share(value: float, what: str) -> None:
    if not 0.0 <= value <= 1.0:
        raise ConfigError(f"{what} must lie between 0 and 1, not {value}")


@dataclass(frozen=True)
class Reliability:
    weights: dict[str, float] = field(default_factory=lambda: dict(RELIABILITY))
    default: float = 0.5

    def __post_init__(self):
        for source, w in self.weights.items():
            _share(w, f"weight of {source}")


@dataclass(frozen=True)
class Rule:
    priority: tuple[str, ...] = DEFAULT_PRIORITY
    strategy: str = "priority"

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ConfigError(f"strategy must be one of {STRATEGIES}, not {self.strategy!r}")
        object.__setattr__(self, "priority", tuple(self.priority))


@dataclass(frozen=True)
class MergeRules:
    field_rules: dict[str, Rule] = field(default_factory=dict)
    default_priority: tuple[str, ...] = DEFAULT_PRIORITY
    default_strategy: str = "priority"

    def rule(self, name: str) -> Rule:
        return self.field_rules.get(name) or Rule(tuple(self.default_priority), self.default_strategy)


@dataclass(frozen=True)
class PhoneRules:
    default_country_code: str = "IN"
    output_format: str = "E164"


@dataclass(frozen=True)
class DateRules:
    output_format: str = "YYYY-MM"
    assume_day: int = 1


@dataclass(frozen=True)
class SkillRules:
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    case_sensitive: bool = False


@dataclass(frozen=True)
class Normalization:
    phone: PhoneRules = PhoneRules()
    dates: DateRules = DateRules()
    skills: SkillRules = field(default_factory=SkillRules)
    strip_unicode: bool = False
    normalize_whitespace: bool = True


@dataclass(frozen=True)
class Projected:
    source: str
    output_name: str
    include: bool = True
    default: Any = None


@dataclass(frozen=True)
class Projection:
    fields: tuple[Projected, ...] = ()
    include_confidence: bool = True
    include_provenance: bool = False
    include_validation: bool = True

    def included(self) -> list[Projected]:
        return [f for f in self.fields if f.include]

    def output_map(self) -> dict[str, str]:
        """Source field to output name, for included fields."""
        return {f.source: f.output_name for f in self.included()}


@dataclass(frozen=True)
class Resolution:
    name_similarity_threshold: float = 0.85
    email_exact_match: bool = True
    skill_similarity_threshold: float = 0.80  # accepted, not used
    company_similarity_threshold: float = 0.80  # accepted, not used

    def __post_init__(self):
        for f in ("name_similarity_threshold", "skill_similarity_threshold", "company_similarity_threshold"):
            _share(getattr(self, f), f)


@dataclass(frozen=True)
class FieldSimilarity:
    full_threshold: float = 0.95
    partial_threshold: float = 0.80
    skip_agreement: bool = False


@dataclass(frozen=True)
class Freshness:
    half_life_days: float = 365.0
    min_freshness: float = 0.5
    staleness_fields: tuple[str, ...] = ("phone", "location", "summary", "experience")


@dataclass(frozen=True)
class Diversity:
    enabled: bool = True
    max_bonus: float = 0.05
    min_sources: int = 2
    min_reliability: float = 0.75


@dataclass(frozen=True)
class AdaptiveWeights:
    one_source_field: float = 0.70
    one_source_completeness: float = 0.30
    one_source_agreement: float = 0.0
    two_source_field: float = 0.50
    two_source_completeness: float = 0.25
    two_source_agreement: float = 0.25
    many_source_field: float = 0.45
    many_source_completeness: float = 0.20
    many_source_agreement: float = 0.35
    many_threshold: int = 5

    def triplet(self, kind: str) -> tuple[float, float, float]:
        return tuple(getattr(self, f"{kind}_source_{part}") for part in ("field", "completeness", "agreement"))

    def __post_init__(self):
        for kind in ("one", "two", "many"):
            if abs(sum(self.triplet(kind)) - 1) > 1e-4:
                raise ConfigError(f"the {kind}-source weights must add up to 1")


@dataclass(frozen=True)
class Categories:
    required_fields: tuple[str, ...] = ("name", "email", "phone", "skills", "experience", "education")
    recommended_fields: tuple[str, ...] = ("links",)
    optional_fields: tuple[str, ...] = ("summary", "location")


def _similarities() -> dict[str, FieldSimilarity]:
    return {"name": FieldSimilarity(0.90, 0.70), "email": FieldSimilarity(1.0, 0.95), "phone": FieldSimilarity(1.0, 0.90), "location": FieldSimilarity(0.85, 0.65), "summary": FieldSimilarity(skip_agreement=True)}


def _location_aliases() -> dict[str, str]:
    from .functions.vocabulary import LOCATION_ALIASES

    return dict(LOCATION_ALIASES)


@dataclass(frozen=True)
class Confidence:
    field_categories: Categories = Categories()
    field_weights: dict[str, float] = field(default_factory=lambda: dict(FIELD_WEIGHTS))
    similarity_full_threshold: float = 0.95
    similarity_partial_threshold: float = 0.80
    max_agreement_bonus: float = 0.05
    conflict_penalty: float = 0.10
    error_penalty: float = 0.05
    warning_penalty: float = 0.01
    max_error_penalty: float = 0.20
    max_warning_penalty: float = 0.10
    field_similarity: dict[str, FieldSimilarity] = field(default_factory=_similarities)
    recency: dict = field(default_factory=dict)  # accepted, not used
    freshness: Freshness = Freshness()
    diversity: Diversity = Diversity()
    adaptive_weights: AdaptiveWeights = AdaptiveWeights()
    location_aliases: dict[str, str] = field(default_factory=_location_aliases)

    def __post_init__(self):
        if abs(sum(self.field_weights.values()) - 1) > 1e-4:
            raise ConfigError("field_weights must add up to 1")

    def thresholds(self, name: str) -> FieldSimilarity:
        return self.field_similarity.get(name) or FieldSimilarity(self.similarity_full_threshold, self.similarity_partial_threshold)


@dataclass(frozen=True)
class Config:
    version: str = "1.0.0"
    log_level: str = "INFO"
    source_reliability: Reliability = field(default_factory=Reliability)
    merge_rules: MergeRules = field(default_factory=MergeRules)
    normalization: Normalization = field(default_factory=Normalization)
    projection: Projection = field(default_factory=Projection)
    entity_resolution: Resolution = field(default_factory=Resolution)
    confidence: Confidence = field(default_factory=Confidence)
    output_dir: str = "output"
    output_filename: str = "candidate_profile.json"

    def __post_init__(self):
        if self.log_level.upper() not in LEVELS:
            raise ConfigError(f"log_level must be one of {LEVELS}, not {self.log_level!r}")
        object.__setattr__(self, "log_level", self.log_level.upper())


def standard() -> Config:
    """The configuration that the engine ships with."""
    return Config(
        source_reliability=Reliability(dict(STANDARD_RELIABILITY)),
        merge_rules=MergeRules({f: Rule(priority, strategy) for f, (strategy, priority) in STANDARD_RULES.items()}),
        normalization=Normalization(skills=SkillRules({k: list(v) for k, v in STANDARD_SYNONYMS.items()})),
        projection=Projection(tuple(Projected(s, o, True, [] if s in LIST_FIELDS else None) for s, o in STANDARD_PROJECTION.items())),
    )


def _build(kind: type, raw: Any) -> Any:
    """A dataclass from plain YAML values; keys it has not are ignored."""
    if not is_dataclass(kind) or not isinstance(raw, dict):
        return raw
    hints = {f.name: _TYPES.get((kind, f.name)) for f in fields(kind)}
    values = {}
    for name, value in raw.items():
        if name not in hints:
            continue
        inner = hints[name]
        if isinstance(inner, dict):  # a map of dataclasses
            value = {k: _build(inner["of"], v) for k, v in value.items()}
        elif isinstance(inner, list):
            value = tuple(_build(inner[0], v) for v in value)
        elif inner is not None:
            value = _build(inner, value)
        elif isinstance(value, list):
            value = tuple(value)
        values[name] = value
    try:
        return kind(**values)
    except TypeError as e:
        raise ConfigError(str(e)) from e


_TYPES = {
    (MergeRules, "field_rules"): {"of": Rule}, (Normalization, "phone"): PhoneRules, (Normalization, "dates"): DateRules, (Normalization, "skills"): SkillRules,
    (Projection, "fields"): [Projected], (Confidence, "field_categories"): Categories, (Confidence, "field_similarity"): {"of": FieldSimilarity},
    (Confidence, "freshness"): Freshness, (Confidence, "diversity"): Diversity, (Confidence, "adaptive_weights"): AdaptiveWeights,
    (Config, "source_reliability"): Reliability, (Config, "merge_rules"): MergeRules, (Config, "normalization"): Normalization,
    (Config, "projection"): Projection, (Config, "entity_resolution"): Resolution, (Config, "confidence"): Confidence,
}

_PARTS = {"source_reliability": Reliability, "merge_rules": MergeRules, "normalization": Normalization, "projection": Projection, "entity_resolution": Resolution}
_PROJECTION_KEYS = ("fields", "include_confidence", "include_provenance", "include_validation")


def _yaml(path: str) -> dict:
    import yaml

    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


@lru_cache(maxsize=1)
def load(path: str) -> Config:
    """From a pipeline.yaml and the files beside it, or from a projection file alone."""
    raw, folder = _yaml(path), os.path.dirname(path)
    own = raw.pop("projection", None) if isinstance(raw.get("projection"), dict) else {k: raw[k] for k in _PROJECTION_KEYS if k in raw}
    raw = {k: v for k, v in raw.items() if k not in _PROJECTION_KEYS}
    parts = {name: _build(kind, (own if name == "projection" and own else None) or _yaml(os.path.join(folder, f"{name}.yaml"))) for name, kind in _PARTS.items()}
    return replace(_build(Config, {k: v for k, v in raw.items() if k not in parts}), **parts)
