"""Stages of a run: layered settings, stages that can be switched off, and their tables.

[F31] Settings are plain dictionaries laid over each other. [M20] A stage is a function of the settings and the tables so far; its result is
written once to the run's folder, and a stage that is switched off, or that an earlier run finished, is read from there.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .sources.textfiles import load_or_build

Stage = Callable[[dict, dict[str, DataFrame]], DataFrame]


def layered(*settings: dict) -> dict:
    """Later settings over earlier ones, dictionary by dictionary."""
    out: dict = {}
    for s in settings:
        for k, v in s.items():
            out[k] = layered(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


@dataclass
class Run:
    """[M20, M23] A named run: its folder, settings and stages in order."""

    spark: SparkSession
    folder: str
    settings: dict = field(default_factory=dict)
    stages: list[tuple[str, Stage]] = field(default_factory=list)

    def stage(self, name: str, build: Stage) -> Run:
        self.stages.append((name, build))
        return self

    def __call__(self) -> dict[str, DataFrame]:
        """Tables of all stages. ``settings["stages"][name] = False`` leaves a stage out, unless an earlier run wrote it."""
        tables: dict[str, DataFrame] = {}
        on = self.settings.get("stages", {})
        for name, build in self.stages:
            path = f"{self.folder}/{name}"
            if on.get(name, True):
                tables[name] = load_or_build(self.spark, path, lambda build=build: build(self.settings, tables))
            else:
                try:
                    tables[name] = self.spark.read.parquet(path)
                except Exception as e:  # the stage is off and was never run
                    if "PATH_NOT_FOUND" not in str(e):
                        raise
        return tables

    def describe(self) -> str:
        """Settings and stages as JSON, for a run's log."""
        return json.dumps({"folder": self.folder, "settings": self.settings, "stages": [n for n, _ in self.stages]}, sort_keys=True, default=str)


def experiments(mixes: int = 10, keeps: tuple[float, ...] = (0.8, 1.0)) -> dict[str, dict]:
    """[M23] The settings of a sweep by rule: shares of the second loss from 0 in steps of a tenth, each with every keep rate of dropout; by name."""
    return {f"mix{m}-keep{round(k * 100)}": {"loss_mix": m / 10, "keep": k} for m in range(mixes) for k in keeps}


def learning_rate(base: float, decay: float, costs: list[float], window: int = 3) -> float:
    """[M16, M23] The rate after a list of validation costs: multiplied by ``decay`` once for each cost above those of the ``window`` before it."""
    rises = sum(c > max(costs[i - window : i]) for i, c in enumerate(costs) if i >= window)
    return base * decay**rises
