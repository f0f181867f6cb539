"""Online weighting of experts by their bounded losses, as folds over ordered rows of loss maps."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold


class AdaHedge:
    """Exponential weights whose rate follows from the mixability gap; a change of the expert set clears all evidence.

    Losses are cut to [0, 1] unless not ``bounded``.
    """

    def __init__(self, bounded: bool = True):
        self.bounded = bounded
        self.ids: tuple = ()
        self.resets = 0
        self.restart()

    def restart(self) -> None:
        self.total, self.gap = np.zeros(len(self.ids)), 0.0

    def _meet(self, ids: tuple) -> None:
        if ids != self.ids:
            self.resets += bool(self.ids)
            self.ids = ids
            self.restart()

    def weights(self, ids: tuple) -> np.ndarray:
        self._meet(ids)
        above = self.total - self.total.min()
        if len(ids) <= 1 or self.gap <= 0:
            leads = above == 0
            return leads / leads.sum()
        raw = np.exp(-math.log(len(ids)) / self.gap * above)
        return raw / raw.sum()

    def update(self, losses: np.ndarray, p: np.ndarray) -> None:
        losses = np.clip(losses, 0, 1) if self.bounded else losses
        active = p > 0
        if len(self.ids) <= 1 or self.gap <= 0:
            mix = losses[active].min()
        else:
            eta = math.log(len(self.ids)) / self.gap
            mix = -np.logaddexp.reduce(np.log(p[active]) - eta * losses[active]) / eta
        self.gap += max(0.0, float(p @ losses - mix))
        self.total = self.total + losses

    def replay(self, rows: list[np.ndarray]) -> None:
        """Evidence rebuilt from a sequence of losses of the same experts."""
        self.restart()
        for losses in rows:
            self.update(losses, self.weights(self.ids))

    def leader(self, preferred=None):
        lead = [i for i, x in zip(self.ids, self.total) if x == self.total.min()]
        return preferred if preferred in lead else min(lead)


class FixedShare:
    """Exponential weights with a rate from the observed variance, and a share of 1 / ``horizon`` dealt to all at each step.

    Losses are cut to [0, 1] unless not ``bounded``.
    """

    def __init__(self, horizon: int = 30, bounded: bool = True):
        self.bounded = bounded
        self.share = 1 / max(2, horizon)
        self.ids: tuple = ()
        self.restart()

    def restart(self) -> None:
        self.w, self.variance, self.switches, self.last = np.full(len(self.ids), 1 / max(1, len(self.ids))), 0.0, 0, None

    def weights(self, ids: tuple) -> np.ndarray:
        if ids != self.ids:
            self.ids = ids
            self.restart()
        return self.w

    def update(self, losses: np.ndarray, p: np.ndarray) -> None:
        losses = np.clip(losses, 0, 1) if self.bounded else losses
        k = len(self.ids)
        self.variance += float(p @ (losses - p @ losses) ** 2)
        eta = min(1.0, math.sqrt(2 * math.log(k) / max(self.variance, 1e-12))) if k > 1 else 1.0
        posterior = p * np.exp(-eta * losses)
        self.w = (1 - self.share) * posterior / posterior.sum() + self.share / k
        lead = self.ids[int(np.argmax(self.w))]
        self.switches += self.last is not None and lead != self.last
        self.last = lead


def says_yes(score: float) -> bool:
    """The class that a score in [0, 1] predicts; half is no. Scores count to nine decimals."""
    return round(score, 9) > 0.5


class Layers:
    """Routers over experts, and routers over these routers, for a label in {0, 1} and experts' scores in [0, 1].

    The first layer mixes all experts, once with evidence since the beginning (``whole``) and once with a share that lets the best one
    change (``shifting``); what ``whole`` predicts is the context, and each context has a router of its own, whose heaviest expert leads there.
    The second layer weighs, in each context, the whole mixture against that leader by whether they were right (``meta``). The top
    follows ``meta`` or ``shifting``, whichever weighs more (``meta`` if they weigh the same).
    All predict before any learns from the label. Unless ``bounded``, scores may lie outside [0, 1], and losses are not cut.
    """

    def __init__(self, experts: int, horizon: int = 30, bounded: bool = True):
        self.ids, self.bounded = tuple(range(experts)), bounded
        self.whole, self.shifting, self.top = AdaHedge(bounded), FixedShare(horizon, bounded), FixedShare(horizon)
        self.contexts: dict[bool, tuple[AdaHedge, AdaHedge]] = {}

    def step(self, label: int, scores: np.ndarray) -> dict:
        p_whole, p_shifting = self.whole.weights(self.ids), self.shifting.weights(self.ids)
        mixed, shifted = float(p_whole @ scores), float(p_shifting @ scores)
        context = says_yes(mixed)
        own, meta = self.contexts.setdefault(context, (AdaHedge(self.bounded), AdaHedge()))
        p_own, p_meta, p_top = own.weights(self.ids), meta.weights((0, 1)), self.top.weights((0, 1))
        leader = int(np.argmax(np.round(p_own, 9)))
        layered = float(p_meta @ (mixed, scores[leader]))
        follows_meta = round(p_top[0] - p_top[1], 9) >= 0
        said = {"global": mixed, "leader": float(scores[leader]), "shifting": shifted, "meta": layered, "top": layered if follows_meta else shifted}
        right = {name: says_yes(score) == bool(label) for name, score in said.items()}
        losses = 1 - scores if label else scores
        self.whole.update(losses, p_whole)
        self.shifting.update(losses, p_shifting)
        own.update(losses, p_own)
        meta.update(np.array([not right["global"], not right["leader"]], dtype=float), p_meta)
        self.top.update(np.array([not right["meta"], not right["shifting"]], dtype=float), p_top)
        return {"context": int(context), "expert": leader, "leader_weight": float(p_meta[1]), "meta": layered, "shifting": shifted, "follows_meta": bool(follows_meta), "right": right}


#: The predictors of :class:`Layers` whose hits are told.
PREDICTORS = ("global", "leader", "shifting", "meta", "top")


def route_layers(df: DataFrame, experts: list[str], key: list[str], order: str, label: str, horizon: int = 30, bounded: bool = True) -> DataFrame:
    """Of each row, before it is learned from: ``context``, ``expert`` (the context's leader), ``leader_weight``, scores ``meta`` and ``shifting``, ``follows_meta``, and
    for each predictor whether it was ``right_``. Columns ``experts`` hold scores, in [0, 1] if ``bounded``."""

    def start():
        layers = Layers(len(experts), horizon, bounded)

        def step(at, y, *scores):
            out = layers.step(int(y), np.array(scores, dtype=float))
            return int(at), out["context"], experts[out["expert"]], out["leader_weight"], out["meta"], out["shifting"], out["follows_meta"], *(out["right"][p] for p in PREDICTORS)

        return step

    rights = ", ".join(f"right_{p} boolean" for p in PREDICTORS)
    return fold(df, key, [order], start, [order, label, *experts], f"{order} long, context int, expert string, leader_weight double, meta double, shifting double, follows_meta boolean, {rights}")


def effective_count(weights: np.ndarray) -> float:
    return float(1 / (weights**2).sum())


def route(df: DataFrame, make: Callable, experts: list[str], key: list[str], order: str) -> DataFrame:
    """Weights before each row's losses are seen: ``order``, ``w_<expert>``, ``mixture`` (their loss), ``effective``, ``leader``.

    An expert with a null loss isn't there; the weights of absent ones are 0.
    """

    def start():
        router = make()

        def step(at, *losses):
            here = tuple(i for i, x in enumerate(losses) if x is not None and x == x)
            if not here:
                return None
            x = np.array([losses[i] for i in here])
            p = router.weights(here)
            lead = min(i for i, w in zip(here, p) if w == p.max())
            row = (int(at), *(float(dict(zip(here, p)).get(i, 0.0)) for i in range(len(losses))), float(p @ x), effective_count(p), experts[lead])
            router.update(x, p)
            return row

        return step

    columns = ", ".join(f"w_{e} double" for e in experts)
    return fold(df, key, [order], start, [order, *experts], f"{order} long, {columns}, mixture double, effective double, leader string")


def route_with_replay(df: DataFrame, experts: list[str], key: list[str], order: str, every: int, stored: int, bounded: bool = True) -> DataFrame:
    """AdaHedge whose evidence is looked at after every ``every`` rows: if the expert of least loss over the last ``stored`` rows isn't the one
    of least evidence so far (which stays where they are even), the evidence is rebuilt from these rows, and the router carries on with it. One row for
    each look: ``round``, ``replayed``, ``lead``, the weights ``w_<expert>`` after it, and the mixture's ``loss`` over the rows since the last."""

    def start():
        router, ids, held, seen, loss = AdaHedge(bounded), tuple(range(len(experts))), [], 0, 0.0

        def step(at, *losses):
            nonlocal seen, loss
            x, p = np.array(losses, dtype=float), router.weights(ids)
            loss += float(p @ x)
            router.update(x, p)
            held.append(x)
            del held[:-stored]
            seen += 1
            if seen % every:
                return None
            recent = np.round(np.sum(held, axis=0), 9)
            old = int(np.argmin(np.round(router.total, 9)))
            new = old if recent[old] == recent.min() else int(np.argmin(recent))
            if new != old:
                router.replay(held)
            row = (seen // every - 1, new != old, experts[new], *map(float, router.weights(ids)), loss)
            loss = 0.0
            return row

        return step

    weights = ", ".join(f"w_{e} double" for e in experts)
    return fold(df, key, [order], start, [order, *experts], f"round long, replayed boolean, lead string, {weights}, loss double")


def recalibration(losses: DataFrame, stored: DataFrame, experts: list[str], key: str, round_col: str) -> DataFrame:
    """Of each key and round: ``old``, the expert of least loss over this and all earlier rounds; ``lead``, that of the ``stored`` losses of the round
    (in two parts, ``half`` 0 and 1); ``replay``, whether they differ, so that evidence is rebuilt from the stored losses; and ``both_halves``,
    whether the new leader also beats the old one in either half. Ties go to the first expert; sums count to nine decimals.

    Grouped sums and one running sum over rounds; no key's losses are held together.
    """
    total = lambda where=None: [F.round(F.sum(e if where is None else F.when(where, F.col(e))), 9).alias(e) for e in experts]
    least = lambda of: F.array_min(F.array(*[F.struct(F.col(f"{of}.{e}").alias("x"), F.lit(i).alias("i")) for i, e in enumerate(experts)]))["i"]
    past = Window.partitionBy(key).orderBy(round_col)
    of_round = losses.groupBy(key, round_col).agg(*total())
    old = of_round.select(key, round_col, F.struct(*[F.sum(e).over(past).alias(e) for e in experts]).alias("sums"))
    parts = [F.struct(*total(w)).alias(n) for n, w in (("all", None), ("early", F.col("half") == 0), ("late", F.col("half") == 1))]
    kept = stored.groupBy(F.col(key).alias("__key"), F.col(round_col).alias("__round")).agg(*parts)
    both = old.join(kept, F.col(key).eqNullSafe(F.col("__key")) & (F.col(round_col) == F.col("__round"))).withColumns({"i": least("sums"), "j": least("all")})
    better = lambda of: F.get(F.array(*[F.col(f"{of}.{e}") for e in experts]), F.col("j")) < F.get(F.array(*[F.col(f"{of}.{e}") for e in experts]), F.col("i"))
    named = lambda at: F.get(F.array(*map(F.lit, experts)), F.col(at))
    changed = F.col("i") != F.col("j")
    return both.select(key, round_col, named("i").alias("old"), named("j").alias("lead"), changed.alias("replay"), F.coalesce(changed & better("early") & better("late"), F.lit(False)).alias("both_halves"))
