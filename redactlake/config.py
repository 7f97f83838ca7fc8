"""Defaults of a run, and their overlay by what a caller gives."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Config:
    chunk_seconds: float = 5.0
    text_interval_ms: int = 350
    face_interval_ms: int = 200
    face_mode: str = "all"
    max_gap_ms: int = 900
    min_observations: int = 2
    keep_single_confidence: float = 0.93
    merge_gap_ms: int = 1_200
    reference_similarity: float = 0.363
    identity_threshold: float = 0.40
    usable_timestamps: int = 3
    child_confidence: float = 0.70
    consensus_fraction: float = 0.70
    blur_uncertain: bool = False
    include_values: bool = False


# Names that a mode goes by besides its own.
_MODES = {
    "off": {"none", "disabled"},
    "all": {"blur_all", "all_faces"},
    "reference": set(),
    "likely_minors": {"likely_minor", "minors", "children", "visually_apparent_children"},
}
# Texts that say yes or no.
_TRUTH = {"true": True, "yes": True, "on": True, "1": True, "false": False, "no": False, "off": False, "0": False}


def face_mode(value: str) -> str:
    """off, all, reference or likely_minors, by any of their names; words may be joined by spaces, hyphens or underscores."""
    words = "_".join(re.split(r"[-_ ]", value.strip().lower()))
    for mode, others in _MODES.items():
        if words == mode or words in others:
            return mode
    raise ValueError(f"unknown face mode {value!r}")


def _cast(name: str, default: Any, given: Any) -> Any:
    """A setting in the type of its default. Switches take booleans and plain words for them only, numbers no booleans."""
    if isinstance(default, bool):
        found = given if isinstance(given, bool) else _TRUTH.get(given.strip().lower()) if isinstance(given, str) else None
        if found is None:
            raise ValueError(f"{name} must be true or false, not {given!r}")
        return found
    if isinstance(default, str):
        if not isinstance(given, str):
            raise ValueError(f"{name} must be a text, not {given!r}")
        return face_mode(given) if name == "face_mode" else given
    if isinstance(given, bool) or not isinstance(given, (int, float, str)):
        raise ValueError(f"{name} must be a number, not {given!r}")
    return type(default)(given)


def overlay(config: Config, given: Any) -> Config:
    """The config with known keys of the given object put in."""
    if not isinstance(given, dict):
        raise ValueError("settings must be an object")
    known = {f.name for f in fields(config)}
    return replace(config, **{k: _cast(k, getattr(config, k), v) for k, v in given.items() if k in known})
