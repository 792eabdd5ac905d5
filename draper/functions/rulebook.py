"""The options that rules, features and roasts obey, compiled from a checked configuration.

``DEFAULT`` is the engine's own table. ``compile_rules`` checks a loaded configuration (every option
of settings.SCORING) and gives a rulebook; operators take one, and turn its numbers into
literals and its tables into map look-ups of their plans, so an option costs no join.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from draper.functions import settings
from draper.functions import vocab as V

#: Option of a configuration -> field of a rulebook, where a value is taken as it is.
FIELDS = {
    "color.achromatic_chroma": "achromatic", "color.analogous_max": "analogous", "color.complementary_tolerance": "complementary", "color.triadic_tolerance": "triadic",
    "color.hue_separation": "separation", "color.max_hue_families": "max_families", "formality.levels": "levels", "formality.max_spread": "max_formality",
    "formality.major_spread": "major_formality", "season.fabric_warmth": "warmth", "season.sleeve_exposure": "sleeves", "season.length_exposure": "lengths",
    "season.heavy_warmth": "heavy", "season.summer_exposure": "summer", "season.max_fabric_warmth_spread": "warmth_spread", "harmony.min_lightness_contrast": "min_lightness",
    "harmony.monochrome_lightness_contrast": "mono_lightness", "harmony.max_patterns": "max_patterns", "proportion.accessory_slots": "accessories",
    "proportion.dominant_slots": "dominant", "proportion.core_slots": "core", "proportion.max_accessories": "max_accessories", "proportion.max_single_area": "max_area",
    "proportion.max_upper_lower_ratio": "max_ratio", "proportion.min_measured_areas": "min_measured", "proportion.min_garments_for_footwear": "min_garments",
    "weights": "weights", "defaults.base": "base", "defaults.unscorable": "unscorable", "defaults.max_issue_refs": "max_refs",
}


def _copy(value: Any):
    return field(default_factory=lambda: type(value)(value))


@dataclass(frozen=True)
class Rulebook:
    achromatic: float = V.ACHROMATIC
    analogous: float = V.ANALOGOUS
    complementary: float = V.TOLERANCE
    triadic: float = V.TOLERANCE
    separation: float = V.SEPARATION
    max_families: int = V.MAX_FAMILIES
    levels: Mapping[str, int] = _copy(V.FORMALITY)
    max_formality: int = V.MAX_FORMALITY
    major_formality: int = V.MAJOR_FORMALITY
    warmth: Mapping[str, float] = _copy(V.WARMTH)
    sleeves: Mapping[str, float] = _copy(V.SLEEVE_EXPOSURE)
    lengths: Mapping[str, float] = _copy(V.LENGTH_EXPOSURE)
    heavy: float = V.HEAVY
    summer: float = V.SUMMER
    warmth_spread: float = V.WARMTH_SPREAD
    min_lightness: float = V.MIN_LIGHTNESS
    mono_lightness: float = V.MONO_LIGHTNESS
    max_patterns: int = V.MAX_PATTERNS
    accessories: list[str] = _copy(V.ACCESSORIES)
    dominant: list[str] = _copy(V.DOMINANT)
    core: list[str] = _copy(V.CORE)
    max_accessories: int = V.MAX_ACCESSORIES
    max_area: float = V.MAX_AREA
    max_ratio: float = V.MAX_RATIO
    min_measured: int = V.MIN_MEASURED
    min_garments: int = 2
    weights: Mapping[str, float] = field(default_factory=lambda: dict.fromkeys(settings.AXES, 1.0))
    penalties: Mapping[str, float] = _copy(V.PENALTY)
    base: float = 100.0
    #: Subscores of an outfit without any evidence; None: such an outfit obeys the rules like any other.
    unscorable: float | None = V.UNSCORABLE
    max_refs: int = 5

    @property
    def clash(self) -> float:
        """Hues this far apart or farther are complementary."""
        return 180 - self.complementary


DEFAULT = Rulebook()


def compile_rules(config: Mapping[str, Any]) -> Rulebook:
    """The rulebook of a configuration; a ConfigError names the first option that is not what it has to be."""
    settings.scoring_settings(config)
    values = {name: settings.option(config, path) for path, name in FIELDS.items()}
    values["levels"] = {str(k): v for k, v in values["levels"].items()}
    penalties = {("formality_per_level" if k == settings.PER_LEVEL else k): float(v) for k, v in config["penalties"].items()}
    return Rulebook(**values, penalties={k: penalties[k] for k in V.PENALTY})


def load_rules(path: str) -> Rulebook:
    return compile_rules(settings.load_config(path))
