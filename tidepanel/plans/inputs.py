"""The derived tables every registered query starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepanel.operators.features import build_features
from tidepanel.operators.labels import build_labels
from tidepanel.sources import panels
from tidepanel.sources.schemas import PANEL_KEYS
from tidepanel.sources.storage import written


class Dataset:
    """Derived tables over one data directory; lazy, but for those that ``store`` writes at once."""

    def __init__(self, spark: SparkSession, sf_dir: str, level: str = "nation"):
        self.spark, self.sf_dir, self.level = spark, sf_dir, level
        self._made: dict[str, DataFrame] = {}

    def store(self, *names: str) -> "Dataset":
        """Write the named tables once, for jobs that read them in several branches."""
        for name in names:
            self._made[name] = written(getattr(self, name), name)
        return self

    def store_features(self, *columns: str) -> "Dataset":
        """Write only the keys and the named feature columns; queries that follow see no others."""
        keys = [c for c in PANEL_KEYS if c not in columns]
        self._made["features"] = written(self.features.select(*keys, *dict.fromkeys(columns)), "features")
        return self

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def daily(self) -> DataFrame:
        return self._once("daily", lambda: panels.panel(self.spark, self.sf_dir, self.level))

    @property
    def dimension(self) -> DataFrame:
        return self._once("dimension", lambda: panels.merchant_dimension(self.spark, self.sf_dir, self.level))

    @property
    def signups(self) -> DataFrame:
        return self._once("signups", lambda: panels.merchant_signups(self.spark, self.sf_dir, self.level))

    @property
    def merchants(self) -> DataFrame:
        return self._once("merchants", lambda: panels.merchants(self.dimension, self.daily))

    @property
    def features(self) -> DataFrame:
        return self._once("features", lambda: build_features(self.daily, self.signups))

    @property
    def labels(self) -> DataFrame:
        return self._once("labels", lambda: build_labels(self.daily))

    @property
    def events(self) -> DataFrame:
        _, last = panels.calendar_bounds(self.spark, self.sf_dir)
        return self._once("events", lambda: panels.scenario_events(self.features, last))
