"""From recordings or stored tables to what models and diagnostics start from (survey X35, X39)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from nightgrid.functions import generators
from nightgrid.operators.binning import centred_epochs
from nightgrid.operators.selectors import spec_columns
from nightgrid.sources.recordings import derived_channels, read_edf, union_datasets

#: What a record's run looks at where nothing is named.
DIAGNOSTICS = ("feature_screen", "pairwise_features", "stage_fit")
EXPERIMENTS = ("apnea_secondwise",)


@dataclass(frozen=True)
class Reference:
    """Rows of all data sets, their labelled epochs, and the features of the chosen experiment."""

    table: DataFrame
    staging: DataFrame
    features: list[str]


def reference_table(tables: dict[str, DataFrame]) -> DataFrame:
    """One data set as it is; several as one table with a ``dataset`` column, in which subjects of different sets stay apart."""
    return next(iter(tables.values())) if len(tables) == 1 else union_datasets(tables)


def staging_reference(tables: dict[str, DataFrame], spec: str = "staging_plus_shared", slot: str = "slot", stage: str = "stage") -> Reference:
    """The table, its 30-second epochs and the columns that ``spec`` takes."""
    table = reference_table(tables)
    features = spec_columns(table, spec)
    keys = ("dataset", "subject_id") if len(tables) > 1 else ("subject_id",)
    return Reference(table, centred_epochs(table, slot, stage, features, keys=keys), features)


def output_folder(root: str, tag: str = "", datasets: tuple[str, ...] = ("ucddb",), default: str = "ucddb") -> str:
    """Where a run's results go: the tag names the data sets unless it is the default one alone."""
    return "/".join(p for p in (root.rstrip("/"), tag and tag + ("" if datasets == (default,) else "__" + "+".join(datasets))) if p)


def record_features(spark: SparkSession, path: str, pipeline: str = "apnea") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Read recordings, derive channels and run a registered graph: its tracks and its feature tables."""
    return generators.run_pipeline(derived_channels(read_edf(spark, path)), pipeline)
