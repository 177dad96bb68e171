"""Thresholds and word lists of all operators, as plain values that a caller can replace."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field

# Words that mark a later title as a fix; the expression that marks a revert.
FIX_WORDS = ("fix", "fixes", "fixed", "fixing", "bug", "bugs", "bugfix", "hotfix", "patch", "patches", "patched")
REVERT = r"\b(revert|undo|rollback)\b"
# File names and name parts by class, tested in the order of functions.paths.file_class.
LOCKFILES = ("package-lock.json", "go.sum", "go.mod", "yarn.lock", "gemfile.lock", "cargo.lock", "poetry.lock", "composer.lock", "pnpm-lock.yaml", "uv.lock", "bun.lockb")
MANIFESTS = ("package.json", "setup.py", "setup.cfg", "cargo.toml", "gemfile", "composer.json", "build.gradle", "pom.xml", "pyproject.toml")
DOCKER = ("docker-compose.yml", "docker-compose.yaml")
SPEC_CONFIG = ("ci_workflow", "lockfile", "manifest", "docker", "readme")
LABELS = ("D", "C", "H", "B", "I", "none")
HARMFUL = ("D", "C", "H", "I")
STRATA = ("revert", "dup", "fix_in_flight", "bm_shared", "overlap_other", "near_miss", "control")
# Columns that tell the outcome, and name parts that a blinded sheet may not show.
LEAKY = ("merged", "merged_a", "merged_b", "both_merged", "merged_later", "closed_a", "closed_b", "state_a", "state_b", "gold", "gold_label", "label_category", "judge_category", "category", "provisional_category", "silver_label", "llm_category")
BLIND_PARTS = ("merged", "closed", "pool", "stratum", "incl_prob", "pi_", "llm", "judge", "silver", "gold", "provisional")


@dataclass(frozen=True)
class Settings:
    # Thresholds, sizes, targets and shares of the study.
    dup_min_tokens: int = 3
    dup_jaccard: float = 0.5
    dup_containment_chars: int = 15
    revert: str = REVERT
    fix_words: tuple[str, ...] = FIX_WORDS
    near_depth: int = 2
    prevalence_n: int = 4000
    prevalence_min: int = 80
    census: int = 50
    targets: dict = field(default_factory=lambda: {"revert": None, "dup": 1500, "fix_in_flight": 800, "bm_shared": 800, "overlap_other": 800, "near_miss": 2000, "control": 2000})
    calibration: dict = field(default_factory=lambda: {"overlap": 30, "dup": 30, "revert": 10, "near_miss": 15, "control": 15})
    calibration_n: int = 100
    validation_n: int = 300
    z: float = 1.959963984540054
    bootstrap: int = 5000
    extreme: float = 50.0
    test_share: float = 0.6
    dev_share: float = 0.4
    min_train: int = 200
    seed: int = 20260824
    body_chars: int = 1200
    file_cap: int = 80
    gold_labels: tuple[str, ...] = LABELS


def deep_merge(base: dict, over: dict) -> dict:
    """base with the values of over; mappings merge key by key."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_settings(layers: list[dict] | None = None) -> Settings:
    """Settings with each layer's values over those of the layers before; an unknown name raises."""
    values = {f.name: getattr(Settings(), f.name) for f in dataclasses.fields(Settings)}
    for layer in layers or []:
        if unknown := set(layer) - set(values):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        values = deep_merge(values, layer)
    return Settings(**values)


def from_file(path: str) -> Settings:
    """Settings from a JSON file (or YAML, where PyYAML is installed), over the file that its `extends` names."""
    import json
    import os

    layers = []
    while path:
        with open(path) as f:
            if path.endswith((".yml", ".yaml")):
                import yaml

                layer = yaml.safe_load(f) or {}
            else:
                layer = json.load(f)
        base = layer.pop("extends", None)
        layers.insert(0, layer)
        path = os.path.join(os.path.dirname(path), base) if base else ""
    return load_settings(layers)
