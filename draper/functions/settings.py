"""Configuration: YAML (or JSON) mappings, and one table of what each option has to be.

A rule of the table is a path, the kind of its value and its range; checking walks the table,
so an option is described in one line and its error names its path.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping
from functools import lru_cache
from types import MappingProxyType
from typing import Any

from draper.functions import vocab as V

AXES = ["color_harmony", "formality_consistency", "seasonality", "proportion"]


class ConfigError(ValueError):
    """An option that is missing or not what it has to be."""


@lru_cache(maxsize=None)
def load_config(path: str) -> Mapping[str, Any]:
    """The mapping of a file, read once for each path."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith(".json"):
            found = json.loads(text)
        else:
            import yaml

            found = yaml.safe_load(text)
    except (OSError, ValueError) as x:
        raise ConfigError(f"could not read {path}: {x}") from x
    except Exception as x:
        if type(x).__module__.startswith("yaml"):
            raise ConfigError(f"could not read {path}: {x}") from x
        raise
    if not isinstance(found, dict):
        raise ConfigError(f"{path} holds no mapping")
    return MappingProxyType(found)


def number(low: float = 0.0, high: float = math.inf) -> Callable[[Any], str | None]:
    def wrong(v: Any) -> str | None:
        if isinstance(v, bool) or not isinstance(v, int | float) or not math.isfinite(v):
            return "a finite number"
        return None if low <= v <= high else f"within [{low}, {high}]"

    return wrong


def whole(low: int, high: int | None = None) -> Callable[[Any], str | None]:
    said = f"a whole number from {low}" + ("" if high is None else f" to {high}")

    def wrong(v: Any) -> str | None:
        return None if isinstance(v, int) and not isinstance(v, bool) and v >= low and (high is None or v <= high) else said

    return wrong


def table(known: list[str] | None, value: Callable[[Any], str | None], key: Callable[[str], bool] = lambda k: True) -> Callable[[Any], str | None]:
    """A mapping with at least one entry, keys among ``known`` without na, and values that are right."""

    def wrong(v: Any) -> str | None:
        if not isinstance(v, dict) or not v:
            return "a mapping with entries"
        for k, x in v.items():
            if known is not None and (k == "na" or k not in known):
                return f"keyed by known names without na; {k!r} is none"
            if not key(str(k)):
                return f"keyed by normalised names; {k!r} is none"
            if said := value(x):
                return f"{said} at {k!r}"
        return None

    return wrong


def members(known: list[str]) -> Callable[[Any], str | None]:
    return lambda v: None if isinstance(v, list) and v and set(v) <= set(known) else f"a list of {', '.join(known)}"


def exactly(names: list[str]) -> Callable[[Any], str | None]:
    def wrong(v: Any) -> str | None:
        if not isinstance(v, dict) or set(v) != set(names):
            return f"a mapping of exactly {', '.join(names)}"
        bad = next((said for x in v.values() if (said := number()(x))), None)
        return bad or (None if sum(v.values()) > 0 else "not all zero")

    return wrong


def covering(names: list[str]) -> Callable[[Any], str | None]:
    def wrong(v: Any) -> str | None:
        lacking = sorted(set(names) - set(v)) if isinstance(v, dict) else names
        return f"a mapping that has {', '.join(lacking)}" if lacking else next((said for n in names if (said := number()(v[n]))), None)

    return wrong


def _normal(k: str) -> bool:
    return k == " ".join(k.replace("-", " ").lower().split())


ANY = number(-math.inf)
#: The name of one penalty in files.
PER_LEVEL = "formality_mismatch_per_level"
SCORING = {
    "color.achromatic_chroma": number(), "color.analogous_max": number(0, 180), "color.complementary_tolerance": number(0, 90), "color.triadic_tolerance": number(0, 60),
    "color.hue_separation": number(0, 180), "color.max_hue_families": whole(1), "formality.levels": table(None, whole(0, 4), _normal), "formality.max_spread": whole(0, 4),
    "formality.major_spread": whole(0, 4), "season.fabric_warmth": table(V.FABRICS, ANY), "season.sleeve_exposure": table(V.SLEEVES, ANY),
    "season.length_exposure": table(V.LENGTHS, ANY), "season.heavy_warmth": ANY, "season.summer_exposure": ANY, "season.max_fabric_warmth_spread": number(),
    "harmony.min_lightness_contrast": number(), "harmony.monochrome_lightness_contrast": number(), "harmony.max_patterns": whole(1),
    "proportion.accessory_slots": members(V.SLOTS), "proportion.dominant_slots": members(V.SLOTS), "proportion.core_slots": members(V.SLOTS),
    "proportion.max_accessories": whole(1), "proportion.max_single_area": number(5e-324, 1), "proportion.max_upper_lower_ratio": number(1),
    "proportion.min_measured_areas": whole(1), "proportion.min_garments_for_footwear": whole(1), "defaults.base": number(0, 100), "defaults.unscorable": number(0, 100),
    "defaults.max_issue_refs": whole(1), "weights": exactly(AXES), "penalties": covering([PER_LEVEL if k == "formality_per_level" else k for k in V.PENALTY]),
}
PALETTE = {
    "palette.seed": whole(0), "palette.n_clusters": whole(1), "palette.n_init": whole(1), "palette.min_area_fraction": number(0, 1), "palette.max_fit_pixels": whole(1),
}


def option(config: Mapping[str, Any], path: str) -> Any:
    at: Any = config
    for name in path.split("."):
        at = at.get(name) if isinstance(at, Mapping) else None
    return at


def check(config: Mapping[str, Any], rules: Mapping[str, Callable[[Any], str | None]]) -> Mapping[str, Any]:
    """The config, if every option of the table is right."""
    for path, wrong in rules.items():
        if said := wrong(option(config, path)):
            raise ConfigError(f"{path} must be {said}; got {option(config, path)!r}")
    return config


def scoring_settings(config: Mapping[str, Any]) -> Mapping[str, Any]:
    """The config, if every scoring option is right, alone and beside the others."""
    check(config, SCORING)
    if config["formality"]["major_spread"] < config["formality"]["max_spread"]:
        raise ConfigError("formality.major_spread must not be below formality.max_spread")
    return config
