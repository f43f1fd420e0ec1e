"""Constraint programs: concepts with properties, each filled by a sensor.

A graph's concepts are tables; a property's sensor says how it comes to be: read from the source, computed from other
properties, predicted by a network, or brought over an edge from another concept. build() puts the sensors in order of
what they need and returns one declarative plan a concept; nothing runs until that is read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ReaderSensor:
    """A column of the source; label: it is the truth of the concept, not an input."""

    keyword: str
    label: bool = False


@dataclass(frozen=True)
class FunctionalSensor:
    """A function of other properties, as Columns."""

    inputs: tuple[str, ...]
    forward: Callable[..., Column]
    label: bool = False


@dataclass(frozen=True)
class ConstantSensor:
    """One value for all rows."""

    value: object
    label: bool = False


@dataclass(frozen=True)
class ModuleLearner:
    """A network over a property: module gives, for a table of keys and that property, key and output."""

    input: str
    module: Callable[[DataFrame, str, str], DataFrame]
    output: str = "probs"
    label: bool = False


@dataclass(frozen=True)
class EdgeSensor:
    """A property of another concept, over a foreign key (a property of this one)."""

    concept: str
    key: str
    property: str
    label: bool = False


@dataclass(frozen=True)
class JointSensor:
    """The rows of a concept itself, made of another concept's: relate maps its table to keys (and foreign keys)."""

    concept: str
    relate: Callable[[DataFrame], DataFrame]


Sensor = ReaderSensor | FunctionalSensor | ConstantSensor | ModuleLearner | EdgeSensor


@dataclass
class Concept:
    name: str
    key: str
    rows: JointSensor | None = None
    properties: dict[str, Sensor] = field(default_factory=dict)

    def __setitem__(self, name: str, sensor: Sensor) -> None:
        self.properties[name] = sensor


@dataclass
class Graph:
    """Concepts by name."""

    concepts: dict[str, Concept] = field(default_factory=dict)

    def concept(self, name: str, key: str, rows: JointSensor | None = None) -> Concept:
        self.concepts[name] = Concept(name, key, rows)
        return self.concepts[name]

    def build(self, sources: dict[str, DataFrame], labels: bool = True) -> dict[str, DataFrame]:
        """A table of each concept: its key, the columns that its rows come with, and its properties. Without labels,
        sensors of the truth are left out."""
        made: dict[str, DataFrame] = {}
        busy: set[str] = set()

        def table(name: str) -> DataFrame:
            if name in made:
                return made[name]
            if name in busy:
                raise ValueError(f"{name} needs itself")
            busy.add(name)
            c = self.concepts[name]
            df = c.rows.relate(table(c.rows.concept)) if c.rows else sources[name]
            todo = {k: s for k, s in c.properties.items() if labels or not s.label}
            while todo:
                ready = [k for k, s in todo.items() if self._needs(s) <= set(df.columns) - (set(todo) - {k})]
                if not ready:
                    raise ValueError(f"{name}: nothing gives what {', '.join(todo)} need")
                for k in ready:
                    df = self._fill(df, c, k, todo.pop(k), table)
            made[name] = df
            return df

        for name in self.concepts:
            table(name)
        return made

    @staticmethod
    def _needs(s: Sensor) -> set[str]:
        return {ReaderSensor: lambda: {s.keyword}, FunctionalSensor: lambda: set(s.inputs), ConstantSensor: set, ModuleLearner: lambda: {s.input}, EdgeSensor: lambda: {s.key}}[type(s)]()

    def _fill(self, df: DataFrame, c: Concept, name: str, s: Sensor, table: Callable[[str], DataFrame]) -> DataFrame:
        if isinstance(s, ReaderSensor):
            return df.withColumn(name, F.col(s.keyword))
        if isinstance(s, FunctionalSensor):
            return df.withColumn(name, s.forward(*map(F.col, s.inputs)))
        if isinstance(s, ConstantSensor):
            return df.withColumn(name, F.lit(s.value))
        if isinstance(s, ModuleLearner):
            out = s.module(df.select(c.key, s.input), c.key, s.input)
            return df.join(out.select(c.key, F.col(s.output).alias(name)), c.key)
        other = table(s.concept)
        return df.join(other.select(F.col(self.concepts[s.concept].key).alias(s.key), F.col(s.property).alias(name)), s.key)

    def forward(self, sources: dict[str, DataFrame], concept: str, key: object) -> tuple[Row | None, DataFrame]:
        """One item through all sensors: its row with all properties, and the plan that made it."""
        plan = self.build(sources)[concept]
        one = plan.filter(F.col(self.concepts[concept].key) == F.lit(key))
        return one.first(), one


__all__ = ["Concept", "ConstantSensor", "EdgeSensor", "FunctionalSensor", "Graph", "JointSensor", "ModuleLearner", "ReaderSensor"]
