"""Options: defaults, YAML over defaults, flag overrides, validation."""

from __future__ import annotations

import dataclasses
import os
from dataclasses import dataclass, field

import yaml


# The defaults below, and the names of keys in load() and save().
@dataclass(frozen=True)
class Weights:
    tree_edit: float = 0.3
    token_similarity: float = 0.3
    structural: float = 0.25
    signature: float = 0.15
    different_signature: float = 0.3

    def total(self) -> float:
        return self.tree_edit + self.token_similarity + self.structural + self.signature

    def balanced(self) -> bool:
        """All positive, and a sum between 0.98 and 1.02."""
        four = (self.tree_edit, self.token_similarity, self.structural, self.signature)
        return min(four) > 0 and 0.98 <= self.total() <= 1.02


@dataclass(frozen=True)
class Options:
    threshold: float = 0.8
    min_lines: int = 5
    format: str = "json"
    workers: int = 0
    max_cache: int = 10_000
    max_line_ratio: float = 3.0
    max_signature_gap: int = 50
    max_empty_gap: int = 5
    similar_operations: float = 0.5
    count_penalty: float = 0.5
    weights: Weights = field(default_factory=Weights)
    ignore_file: str = ".similarityignore"
    ignore_patterns: tuple[str, ...] = ()

    def validate(self) -> Options:
        w = self.weights
        problems = [
            (not 0 <= self.threshold <= 1, "threshold must be in [0, 1]"),
            (self.min_lines <= 0, "min_lines must be positive"),
            (self.format not in ("json", "yaml"), "format must be json or yaml"),
            (self.max_cache <= 0, "max_cache must be positive"),
            (self.max_line_ratio <= 0, "max_line_ratio must be positive"),
            (min(w.tree_edit, w.token_similarity, w.structural, w.signature) <= 0, "weights must be positive"),
            (abs(w.total() - 1) > 0.05, "weights must sum to 1 within 0.05"),
            (not 0 <= w.different_signature <= 1, "different_signature must be in [0, 1]"),
        ]
        for bad, what in problems:
            if bad:
                raise ValueError(what)
        return self

    def override(self, **flags) -> Options:
        """Positive numbers and non-empty strings replace; others are as if not given."""
        given = {k: v for k, v in flags.items() if (isinstance(v, str) and v) or (not isinstance(v, str) and v is not None and v > 0)}
        return dataclasses.replace(self, **given)


#: Names looked for in the working folder, in this order.
CANDIDATES = (".similarity-config.yaml", ".similarity-config.yml", "similarity-config.yaml", "similarity-config.yml")


def load(path: str | None = None, folder: str = ".") -> Options:
    """Options from YAML over the defaults; a missing file gives the defaults."""
    paths = [path] if path else [os.path.join(folder, x) for x in CANDIDATES]
    found = next((p for p in paths if os.path.isfile(p)), None)
    if not found:
        return Options()
    with open(found, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    base, similarity = Options(), raw.get("similarity") or {}
    cli, limits, ignore = raw.get("cli") or {}, similarity.get("limits") or {}, raw.get("ignore") or {}
    weights = {k: float(v) for k, v in (similarity.get("weights") or {}).items() if k in {f.name for f in dataclasses.fields(Weights)}}
    thresholds = similarity.get("thresholds") or {}
    take = {
        "threshold": cli.get("default_threshold"), "min_lines": cli.get("default_min_lines"), "format": cli.get("default_format"), "workers": cli.get("default_workers"),
        "max_cache": limits.get("max_cache_size"), "max_line_ratio": limits.get("max_line_difference_ratio"), "max_signature_gap": limits.get("max_signature_length_diff"),
        "similar_operations": thresholds.get("default_similar_operations"), "count_penalty": thresholds.get("statement_count_penalty"),
        "ignore_file": ignore.get("default_file"), "ignore_patterns": tuple(ignore["patterns"]) if ignore.get("patterns") else None,
    }
    return dataclasses.replace(base, weights=dataclasses.replace(base.weights, **weights), **{k: v for k, v in take.items() if v is not None})


def save(options: Options, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump({
            "cli": {"default_threshold": options.threshold, "default_min_lines": options.min_lines, "default_format": options.format, "default_workers": options.workers},
            "similarity": {
                "weights": dataclasses.asdict(options.weights),
                "limits": {"max_cache_size": options.max_cache, "max_line_difference_ratio": options.max_line_ratio, "max_signature_length_diff": options.max_signature_gap},
                "thresholds": {"default_similar_operations": options.similar_operations, "statement_count_penalty": options.count_penalty},
            },
            "ignore": {"default_file": options.ignore_file, "patterns": list(options.ignore_patterns)},
        }, f, sort_keys=False)
