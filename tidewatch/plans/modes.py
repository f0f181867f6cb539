"""Named pipelines: which detector, resolution, rounds and server a run is made of."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..operators import detectors, experts


@dataclass(frozen=True)
class Mode:
    """A run's parts by name; ``detector`` and ``router`` make fresh state."""

    name: str
    family: str
    detector: Callable | None = None
    by_class: bool = False
    rounds: str = "per_sample"
    clustering: str = "every_round"
    router: Callable | None = None
    backbone: bool = False


def _modes() -> dict[str, Mode]:
    """Every detector, plain and by class, under a plain and a cached server; routers and a shared backbone for the plain Hoeffding test;
    the batch family; and the two baselines that adapt to nothing or share nothing."""
    out = []
    for kind, make in detectors.KINDS.items():
        family = "window" if kind == "adaptive_window" else "stream"
        for by_class in (False, True):
            if by_class and kind == "weighted":
                continue
            name = f"{kind}{'_by_class' * by_class}"
            out += [Mode(name, family, make, by_class), Mode(f"{name}_cached", family, make, by_class, rounds="cached")]
    plain = detectors.KINDS["hoeffding"]
    out += [Mode(f"hoeffding_{n}", "stream", plain, router=r) for n, r in (("adahedge", experts.AdaHedge), ("fixed_share", experts.FixedShare))]
    out += [Mode("hoeffding_backbone", "stream", plain, backbone=True), Mode("hoeffding_backbone_adahedge", "stream", plain, router=experts.AdaHedge, backbone=True)]
    out += [Mode("batch", "batch", rounds="batch"), Mode("local", "baseline", clustering="disabled"), Mode("oblivious", "baseline", clustering="disabled")]
    return {m.name: m for m in out}


MODES = _modes()


def mode(name: str) -> Mode:
    if name not in MODES:
        raise ValueError(f"unknown mode {name!r}; known: {', '.join(sorted(MODES))}")
    return MODES[name]
