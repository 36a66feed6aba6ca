"""Pipelines of steps over tile tables.

A step is a named function with parameters. Frame steps turn a DataFrame into a DataFrame and stay in
Catalyst. Batch steps work on a dictionary of numpy arrays per tile; adjacent ones are fused into a
single pass through Python, because each pass costs a round trip of the pixels.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from tesselon.operators.grid import require

_STEPS: dict[str, tuple[Callable, bool]] = {}
#: What the tiles of a step must be: values by column.
_NEEDS: dict[str, dict[str, str]] = {}


def step(name: str, batch: bool = False, needs: dict[str, str] | None = None):
    """Register a function as a step; ``batch`` for functions of a pandas frame of tiles.

    ``needs`` names columns and the value that each tile must have there, such as a stain; other tiles
    are an error when they come to the step.
    """

    def register(function: Callable) -> Callable:
        _STEPS[name] = (function, batch)
        _NEEDS[name] = needs or {}
        return function

    return register


@dataclass(frozen=True)
class Step:
    name: str
    params: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.name not in _STEPS:
            raise ValueError(f"unknown step {self.name!r}")

    @property
    def batch(self) -> bool:
        return _STEPS[self.name][1]

    def __call__(self, value):
        for column, allowed in _NEEDS[self.name].items():
            if isinstance(value, DataFrame):
                value = require(value, column, allowed, self.name)
            elif not (value[column] == allowed).all():
                raise ValueError(f"{self.name} needs {column} {allowed}")
        return _STEPS[self.name][0](value, **self.params)


class Pipeline:
    """Steps in order; itself usable wherever a step is."""

    def __init__(self, steps: list[Step | Pipeline]):
        if not all(isinstance(s, (Step, Pipeline)) for s in steps):
            raise TypeError("a pipeline takes steps and pipelines")
        self.steps = [x for s in steps for x in (s.steps if isinstance(s, Pipeline) else [s])]

    def __len__(self) -> int:
        return len(self.steps)

    def __repr__(self) -> str:
        return f"Pipeline({[s.name for s in self.steps]})"

    def run(self, tiles: DataFrame) -> DataFrame:
        """The plan of all steps over ``tiles``; nothing runs before an action."""
        at = 0
        while at < len(self.steps):
            end = at
            while end < len(self.steps) and self.steps[end].batch:
                end += 1
            if end > at:
                tiles = tiles.mapInPandas(_fused(self.steps[at:end]), tiles.schema)
                at = end
            else:
                tiles = self.steps[at](tiles)
                at += 1
        return tiles

    def to_json(self) -> str:
        return json.dumps([{"step": s.name, "params": s.params} for s in self.steps])

    @classmethod
    def from_json(cls, text: str) -> Pipeline:
        return cls([Step(s["step"], s["params"]) for s in json.loads(text)])


def _fused(steps: list[Step]):
    # The functions themselves travel to the workers, whose registry may not know them.
    calls = [(_STEPS[s.name][0], s.params) for s in steps]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for function, params in calls:
                frame = function(frame, **params)
            yield frame

    return run
