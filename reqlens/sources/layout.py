"""where an experiment's tables lie, derived from the request table's path.

One table holds all splits (partitioned by ``split``), one folder a model."""

from __future__ import annotations

from dataclasses import dataclass
from posixpath import basename, dirname, join, splitext


@dataclass(frozen=True)
class Layout:
    truth: str      # the request table
    prefix: str     # of the experiment
    models: str     # folder of the models

    @property
    def name(self) -> str:
        return splitext(basename(self.truth.rstrip("/")))[0]

    @property
    def splits(self) -> str:
        return join(dirname(self.truth.rstrip("/")), f"{self.prefix}-{self.name}")

    def split(self, split: str) -> str:
        """The partition folder of one split."""
        if split not in ("train", "eval", "test", "unused"):
            raise ValueError(f"unknown split {split!r}")
        return join(self.splits, f"split={split}")

    def model(self, model: str) -> str:
        return join(self.models, model)

    def predictions(self, model: str, split: str = "test") -> str:
        return join(self.model(model), "predictions", f"{self.prefix}-{split}-{self.name}")

    def evaluations(self, model: str, split: str = "test") -> str:
        return join(self.model(model), "evaluations", f"{self.prefix}-{split}-{self.name}")
