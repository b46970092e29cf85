"""Column selection by name: specs, families, model signal lists. Names have ``__`` where recordings have a dot."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Reserved prefixes, identifying columns, and families that are never normalised.
RESERVED = ("label__", "truth__", "aligned__", "pred__")
IDS = ("subject_id", "dataset", "time_seconds", "slot", "epoch_index", "fold")
RATIO_FAMILIES = ("epoch_ratio", "topography")
# Named experiments and the prefixes that each takes.
SPECS = {
    "staging_core": ("spindle_features__", "slow_wave_features__", "eog_rem_features__", "emg_tone_features__", "epoch_ratio_features__"),
    "staging_plus_shared": ("spindle_features__", "slow_wave_features__", "eog_rem_features__", "emg_tone_features__", "epoch_ratio_features__", "pan_tompkins__", "respiration__"),
    "staging_interpretable": ("epoch_ratio_features__", "topography_features__"),
    "apnea_core": ("airflow_morphology__", "spo2_drop__", "effort_snore_features__", "apnea_events__"),
    "apnea_plus_shared": ("airflow_morphology__", "spo2_drop__", "effort_snore_features__", "apnea_events__", "pan_tompkins__", "respiration__"),
}


def usable_signal(name: str, units: str) -> bool:
    """P1."""
    return units not in ("binary", "class") and not re.search("mask|vector", name)


def spec_columns(df: DataFrame, spec: str, exclude: tuple[str, ...] = ()) -> list[str]:
    """Columns of a named spec, without masks, vectors and exact exclusions."""
    return [c for c in df.columns if c.startswith(SPECS[spec]) and c not in exclude and not re.search("mask|vector", c)]


def numeric_features(df: DataFrame) -> list[str]:
    """P3."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in IDS and not f.name.startswith(RESERVED)]


def normalisable(name: str) -> bool:
    """X10."""
    return not name.startswith(RATIO_FAMILIES)


def norm_of(name: str, overrides: dict[str, str], stored: dict[str, str] | None = None, default: str = "robust_by_subject") -> str:
    """The longest matching prefix of ``overrides``, else what is stored for the feature, else the default."""
    hit = max((p for p in overrides if name.startswith(p)), key=len, default=None)
    return overrides[hit] if hit is not None else (stored or {}).get(name, default)


def family(name: str) -> str:
    """The generator that a feature comes from."""
    return name.split("__", 1)[0]


def without(signals: list[str], drop: tuple[str, ...]) -> list[str]:
    """A model's signal list less some signals; wildcards allowed."""
    return [s for s in signals if not any(fnmatch.fnmatch(s, d) for d in drop)]


def stream_needed(name: str, wanted: tuple[str, ...]) -> bool:
    """Exact, ``^suffix``, or wildcard on either side."""
    return any(name == w or (w.startswith("^") and name.endswith(w[1:])) or fnmatch.fnmatch(name, w) or fnmatch.fnmatch(w, name) for w in wanted)
