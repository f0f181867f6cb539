"""Sweep plans: which configurations run, each named by fingerprints, longest first."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fingerprint

# The sweep's axes and settings.
#: Axes of a sweep: parameter, its values, and what it is where another axis moves.
AXES = {"delta": ((0.005, 0.01, 0.05, 0.1, 0.2), 0.05), "interval": ((20, 50, 100, 200), 50), "batch": ((25, 50, 100, 200), 50), "distance": ((0.05, 0.1, 0.2, 0.3), 0.1)}
#: Which axes a family of modes has.
FAMILIES = {"window": ("delta", "interval"), "stream": ("interval",), "batch": ("batch", "distance"), "baseline": ()}


@dataclass(frozen=True)
class Option:
    """A named choice with its values and what it needs."""

    name: str
    default: object
    choices: tuple = ()
    needs: tuple[str, ...] = ()

    def check(self, value) -> object:
        if self.choices and value not in self.choices:
            raise ValueError(f"{self.name} must be one of {self.choices}, not {value!r}")
        return value


OPTIONS = {
    o.name: o
    for o in (
        Option("detector", "hoeffding", ("adaptive_window", "hoeffding", "weighted", "e_process")),
        Option("by_class", False, (False, True)),
        Option("linkage", "complete", ("complete", "connected")),
        Option("decision", "distance", ("distance", "confidence", "confidence_margin")),
        Option("clustering", "every_round", ("disabled", "every_round", "on_new_model")),
        Option("merge", "destructive", ("destructive", "shared")),
        Option("router", "none", ("none", "adahedge", "fixed_share")),
        Option("recalibration", "none", ("none", "restart", "replay", "leader_changed", "leader_persists"), ("router",)),
        Option("validation", "none", ("none", "holdout", "forward", "disjoint_halves")),
        Option("episodes", False, (False, True)),
        Option("schedule", "random", ("random", "fixed")),
    )
}


def configuration(**chosen) -> dict:
    """All options, checked; options whose needs aren't chosen are left out, so that equal runs have equal fingerprints."""
    if unknown := chosen.keys() - OPTIONS.keys():
        raise ValueError(f"unknown options {sorted(unknown)}")
    full = {k: o.check(chosen.get(k, o.default)) for k, o in OPTIONS.items()}
    return {k: v for k, v in full.items() if all(full[n] != OPTIONS[n].default for n in OPTIONS[k].needs)}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def plan(spark: SparkSession, datasets: list[str], seeds: list[int], modes: dict[str, str]) -> DataFrame:
    """:func:`plan_of` every dataset with every seed."""
    wanted = spark.createDataFrame([(d,) for d in datasets], "dataset string").withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    return plan_of(wanted, modes)


def plan_of(wanted: DataFrame, modes: dict[str, str]) -> DataFrame:
    """One row for each run of ``wanted`` (``dataset``, ``seed``): ``dataset``, ``seed``, ``mode``, ``family``, ``parameter``, ``value``, ``fingerprint``, ``cost``.

    One axis of a mode's family moves at a time, the others stay at their fixed values; modes without axes run once. ``modes``: name to family.
    """
    moves = [(m, f, a, float(v)) for m, f in modes.items() for a in FAMILIES[f] for v in AXES[a][0]]
    moves += [(m, f, None, None) for m, f in modes.items() if not FAMILIES[f]]
    move = [F.struct(F.lit(m).alias("mode"), F.lit(f).alias("family"), F.lit(a).cast("string").alias("parameter"), F.lit(v).cast("double").alias("value")) for m, f, a, v in moves]
    runs = wanted.select("dataset", "seed", F.inline(F.array(*move)))
    cost = F.when(F.col("family") == "batch", 2).otherwise(1) * F.when(F.col("dataset").startswith("mnist"), 10).otherwise(1)
    return runs.select("dataset", "seed", "mode", "family", "parameter", "value", fingerprint("dataset", "seed", "mode", "parameter", "value").alias("fingerprint"), cost.alias("cost"))


def execution_order(runs: DataFrame) -> DataFrame:
    """Longest first: cost, then short intervals, then name."""
    return runs.orderBy(F.desc("cost"), F.when(F.col("parameter") == "interval", F.col("value")), "dataset", "mode", "seed", "parameter", "value")


def write_json(path: str, value) -> None:
    """A small file on the driver, whole or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w") as f:
            f.write(canonical(value))
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


@dataclass
class Manifest:
    """A run's record on the driver: running, then completed with a digest, or failed with the error."""

    path: str
    configuration: dict
    state: dict = field(default_factory=dict)

    def __enter__(self) -> Manifest:
        self._say(status="running", started=datetime.now(timezone.utc).isoformat(timespec="seconds"))
        return self

    def __exit__(self, kind, error, trace) -> None:
        if error is not None:
            self._say(status="failed", error=f"{kind.__name__}: {error}")
        elif self.state.get("status") != "completed":
            self._say(status="failed", error="not completed")

    def complete(self, files: int, content: str) -> None:
        self._say(status="completed", files=files, digest=hashlib.sha256(content.encode()).hexdigest())

    def _say(self, **what) -> None:
        self.state |= what | {"configuration": self.configuration, "fingerprint": digest(self.configuration)}
        write_json(self.path, self.state)


def document() -> str:
    """The options as a Markdown table."""
    rows = [f"| {o.name} | {', '.join(map(str, o.choices))} | {o.default} | {', '.join(o.needs) or '–'} |" for o in OPTIONS.values()]
    return "\n".join(["| option | choices | default | needs |", "|---|---|---|---|", *rows])
