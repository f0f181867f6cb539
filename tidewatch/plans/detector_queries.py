"""Detectors, expert weighting and class-conditional forms over the canonical stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import detectors, experts
from ..sources.streams import STREAM_SQL, stream
from ..sources.tables import table
from .catalog import query




def _all(spark, sf):
    return stream(table(spark, sf, "events"))


def _s(spark, sf):
    """Of the clients' events; the SQL's recursions meet no row without a client."""
    return _all(spark, sf).where("client IS NOT NULL")


_HOEFFDING = STREAM_SQL + """, walk AS (
SELECT client, -1 AS pos, CAST(0 AS BIGINT) AS n, 0.0::DOUBLE AS s, CAST(0 AS BIGINT) AS mn, 0.0::DOUBLE AS ms, CAST(0 AS BIGINT) AS width, false AS alarm, false AS warning, false AS tested FROM stream WHERE pos = 0
UNION ALL
SELECT client, pos, CASE WHEN alarm THEN 0 ELSE n END, CASE WHEN alarm THEN 0 ELSE s END, CASE WHEN alarm THEN 0 ELSE mn END, CASE WHEN alarm THEN 0 ELSE ms END, CASE WHEN alarm THEN greatest(1, n - mn) ELSE n END, alarm, NOT alarm AND warning, mn <> n
FROM (SELECT *, mn <> n AND s / n - ms / mn >= sqrt((n - mn) / (mn * n) * ln(2 / 0.001) / 2) AS alarm, mn <> n AND s / n - ms / mn >= sqrt((n - mn) / (mn * n) * ln(2 / 0.005) / 2) AS warning
 FROM (SELECT client, pos, n, s, CASE WHEN low THEN n ELSE mn END AS mn, CASE WHEN low THEN s ELSE ms END AS ms
  FROM (SELECT *, mn = 0 OR ms / mn + sqrt(ln(1 / 0.001) / (2 * mn)) >= s / n + sqrt(ln(1 / 0.001) / (2 * n)) AS low
   FROM (SELECT x.client, x.pos, w.n + 1 AS n, w.s + x.loss AS s, w.mn, w.ms FROM walk w JOIN stream x ON x.client = w.client AND x.pos = w.pos + 1)))))
"""


@query("det_3_hoeffding", _HOEFFDING + "SELECT client, pos, width FROM walk WHERE alarm")
def det_3(spark, sf):
    return detectors.detect(_s(spark, sf), detectors.HoeffdingMean).select("client", "pos", "width")


@query("det_5_warnings", _HOEFFDING + "SELECT client, pos, width, warning FROM walk WHERE alarm OR warning")
def det_5(spark, sf):
    """Alarms and the looser warnings of the Hoeffding test."""
    return detectors.detect(_s(spark, sf), detectors.HoeffdingMean, warnings=True)


@query("det_4_weighted", STREAM_SQL + """, walk AS (
SELECT client, -1 AS pos, NULL::DOUBLE AS tm, NULL::DOUBLE AS tw, NULL::DOUBLE AS bm, NULL::DOUBLE AS bw, NULL::DOUBLE AS am, NULL::DOUBLE AS aw, 1e300::DOUBLE AS cut, CAST(0 AS BIGINT) AS delay, false AS alarm, CAST(0 AS BIGINT) AS width FROM stream WHERE pos = 0
UNION ALL
SELECT client, pos, CASE WHEN NOT alarm THEN tm END, CASE WHEN NOT alarm THEN tw END, CASE WHEN NOT alarm THEN bm END, CASE WHEN NOT alarm THEN bw END, CASE WHEN NOT alarm THEN am END, CASE WHEN NOT alarm THEN aw END,
  CASE WHEN alarm THEN 1e300 ELSE cut END, CASE WHEN alarm THEN 0 ELSE delay END, alarm, greatest(1, delay)
FROM (SELECT *, coalesce(am - bm > sqrt((bw + aw) * ln(1 / 0.001) / 2), false) AS alarm
 FROM (SELECT client, pos, tm, tw, CASE WHEN low THEN reach ELSE cut END AS cut, CASE WHEN low THEN tm ELSE bm END AS bm, CASE WHEN low THEN tw ELSE bw END AS bw,
   CASE WHEN low THEN 0 ELSE delay + 1 END AS delay, CASE WHEN low THEN NULL WHEN am IS NULL THEN loss ELSE 0.05 * loss + 0.95 * am END AS am,
   CASE WHEN low THEN NULL WHEN am IS NULL THEN 1.0 ELSE 0.05 * 0.05 + 0.95 * 0.95 * aw END AS aw
  FROM (SELECT *, tm + sqrt(tw * ln(1 / 0.001) / 2) AS reach, tm + sqrt(tw * ln(1 / 0.001) / 2) < cut AS low
   FROM (SELECT x.client, x.pos, x.loss, CASE WHEN w.tm IS NULL THEN x.loss ELSE 0.05 * x.loss + 0.95 * w.tm END AS tm, CASE WHEN w.tm IS NULL THEN 1.0 ELSE 0.05 * 0.05 + 0.95 * 0.95 * w.tw END AS tw,
     w.bm, w.bw, w.am, w.aw, w.cut, w.delay FROM walk w JOIN stream x ON x.client = w.client AND x.pos = w.pos + 1)))))
SELECT client, pos, width FROM walk WHERE alarm""")
def det_4(spark, sf):
    return detectors.detect(_s(spark, sf), detectors.WeightedMean).select("client", "pos", "width")


_RATES = detectors.EProcess.RATES


_E_WALK = f"""e_walk AS (
SELECT client, -1 AS pos, {', '.join(f'0.0::DOUBLE AS s{i}' for i in range(5))}, CAST(0 AS BIGINT) AS starts, false AS alarm FROM stream WHERE pos = 0
UNION ALL
SELECT client, pos, {', '.join(f'CASE WHEN alarm THEN 0 ELSE s{i} END' for i in range(5))}, starts, alarm
FROM (SELECT *, ({' + '.join(f's{i}' for i in range(5))}) / 5 >= 1000 AS alarm
 FROM (SELECT x.client, x.pos, CASE WHEN w.alarm THEN 1 ELSE w.starts + 1 END AS starts, {', '.join(f'(1 + w.s{i}) * (1 + {r} * (x.loss / 0.15 - 1)) AS s{i}' for i, r in enumerate(_RATES))}
  FROM e_walk w JOIN stream x ON x.client = w.client AND x.pos = w.pos + 1)))"""


@query("det_2_e_process", STREAM_SQL + f", {_E_WALK} SELECT client, pos FROM e_walk WHERE alarm")
def det_2(spark, sf):
    """Restarted at its alarms; SQL sums each rate's bets over all starts, which is the same while no start is let go."""
    return detectors.detect(_s(spark, sf), lambda: detectors.EProcess(0.15), restart=True).select("client", "pos")


_WINDOW = """
summed AS (SELECT client, pos, sum(loss) OVER w AS s, sum(loss * loss) OVER w AS q FROM stream WINDOW w AS (PARTITION BY client ORDER BY pos)),
pre AS MATERIALIZED (SELECT client, list_prepend(0.0, list(s ORDER BY pos)) AS s, list_prepend(0.0, list(q ORDER BY pos)) AS q FROM summed GROUP BY client),
walk AS (
SELECT client, -1 AS pos, CAST(0 AS BIGINT) AS start, false AS alarm FROM pre
UNION ALL
SELECT client, pos, CASE WHEN best > 0 THEN start + list_position(cuts, best) ELSE start END, coalesce(best > 0, false)
FROM (SELECT *, list_max(cuts) AS best
 FROM (SELECT client, pos, start, CASE WHEN n >= 10 THEN list_transform(range(1, n), lambda c: abs((s[start + c + 1] - s[start + 1]) / c - (s[pos + 2] - s[start + c + 1]) / (n - c))
   - sqrt(2 * variance * ln(2 * n / 0.05) * n / (c * (n - c))) - 2 / 3 * ln(2 * n / 0.05) * n / (c * (n - c))) END AS cuts
  FROM (SELECT *, greatest((q[pos + 2] - q[start + 1]) / n - ((s[pos + 2] - s[start + 1]) / n) ** 2, 1e-12) AS variance
   FROM (SELECT *, pos + 1 - start AS n
    FROM (SELECT client, w.pos + 1 AS pos, greatest(start, w.pos + 1 - 999) AS start, s, q FROM walk w JOIN pre USING (client) WHERE w.pos + 2 < len(s))))))
)"""


@query("det_1_adaptive_window", STREAM_SQL + f", {_WINDOW} SELECT client, pos, pos + 1 - start AS width FROM walk WHERE alarm")
def det_1(spark, sf):
    return detectors.detect(_s(spark, sf), detectors.AdaptiveWindow).select("client", "pos", "width")


@query("det_6_adaptive_window_by_class")
def det_6(spark, sf):
    return detectors.detect_by_class(_s(spark, sf), detectors.AdaptiveWindow)


def _hoeffding_state(p: str, n: str, s: str) -> str:
    """Columns of one test after its value was added: lowest prefix and verdict."""
    return f"""{p}mn = 0 OR {p}ms / {p}mn + sqrt(ln(1 / 0.001) / (2 * {p}mn)) >= {s} / {n} + sqrt(ln(1 / 0.001) / (2 * {n}))"""


@query("det_7_hoeffding_by_class", STREAM_SQL + """, kinds AS (SELECT DISTINCT label FROM stream),
x AS MATERIALIZED (SELECT client, pos, label, loss, row_number() OVER (PARTITION BY client, label ORDER BY pos) AS i FROM stream),
walk AS (
SELECT client, -1 AS pos, CAST(0 AS BIGINT) AS n, 0.0::DOUBLE AS s, CAST(0 AS BIGINT) AS mn, 0.0::DOUBLE AS ms, MAP {}::MAP(VARCHAR, STRUCT(n BIGINT, s DOUBLE, mn BIGINT, ms DOUBLE)) AS parts, 0 AS source, CAST(NULL AS BIGINT) AS split FROM x WHERE pos = 0
UNION ALL
SELECT client, pos, CASE WHEN source > 0 THEN 0 ELSE n END, CASE WHEN source > 0 THEN 0 ELSE s END, CASE WHEN source > 0 THEN 0 ELSE mn END, CASE WHEN source > 0 THEN 0 ELSE ms END,
 CASE WHEN source > 0 THEN MAP {}::MAP(VARCHAR, STRUCT(n BIGINT, s DOUBLE, mn BIGINT, ms DOUBLE)) ELSE map_from_entries(list_concat(list_filter(map_entries(parts), lambda e: e.key <> label), [{'key': label, 'value': {'n': cn, 's': cs, 'mn': cmn, 'ms': cms}}])) END,
 source, CASE source WHEN 1 THEN pos - greatest(1, n - mn) + 1 WHEN 2 THEN -i + greatest(1, cn - cmn) - 1 END
FROM (SELECT *, CASE WHEN mn <> n AND s / n - ms / mn >= sqrt((n - mn) / (mn * n) * ln(2 / 0.001) / 2) THEN 1 WHEN cmn <> cn AND cs / cn - cms / cmn >= sqrt((cn - cmn) / (cmn * cn) * ln(2 / 0.001) / 2) THEN 2 ELSE 0 END AS source
 FROM (SELECT client, pos, label, i, parts, n, s, CASE WHEN low THEN n ELSE mn END AS mn, CASE WHEN low THEN s ELSE ms END AS ms, cn, cs, CASE WHEN clow THEN cn ELSE cmn END AS cmn, CASE WHEN clow THEN cs ELSE cms END AS cms
  FROM (SELECT *, """ + _hoeffding_state("", "n", "s") + " AS low, " + _hoeffding_state("c", "cn", "cs") + """ AS clow
   FROM (SELECT x.client, x.pos, x.label, x.i, w.parts, w.n + 1 AS n, w.s + x.loss AS s, w.mn, w.ms, coalesce(w.parts[x.label].n, 0) + 1 AS cn, coalesce(w.parts[x.label].s, 0) + x.loss AS cs, coalesce(w.parts[x.label].mn, 0) AS cmn, coalesce(w.parts[x.label].ms, 0) AS cms
    FROM walk w JOIN x ON x.client = w.client AND x.pos = w.pos + 1)))))
SELECT w.client, w.pos, source, CASE source WHEN 1 THEN split ELSE (SELECT o.pos FROM x o WHERE o.client = w.client AND o.label = (SELECT label FROM x p WHERE p.client = w.client AND p.pos = w.pos) AND o.i = -w.split) END AS split FROM walk w WHERE source > 0""")
def det_7(spark, sf):
    return detectors.detect_by_class(_s(spark, sf), detectors.HoeffdingMean)


@query("det_8_e_process_by_class")
def det_8(spark, sf):
    out = detectors.detect_e_by_class(_s(spark, sf), 0.15, 5)
    return out.withColumn("log_e", F.round("log_e", 6))


@query("det_12_reset_after_alarm", _HOEFFDING + "SELECT client, pos, width, pos - lag(pos, 1, -1) OVER (PARTITION BY client ORDER BY pos) AS seen FROM walk WHERE alarm")
def det_12(spark, sf):
    """Every alarm is handled by a reset: the values that each alarm's state had seen."""
    return detectors.resets(_s(spark, sf), detectors.HoeffdingMean)


@query("det_12_reset_e_process", STREAM_SQL + f", {_E_WALK} SELECT client, pos, starts AS seen FROM e_walk WHERE alarm")
def det_12b(spark, sf):
    return detectors.resets(_s(spark, sf), lambda: detectors.EProcess(0.15)).select("client", "pos", "seen")


@query("det_13_hypotheses", _HOEFFDING + f""", {_E_WALK},
h AS (SELECT client, CAST(sum(CASE WHEN NOT tested THEN 0 WHEN alarm THEN 1 ELSE 2 END) AS BIGINT) AS mean_tests, count(*) FILTER (WHERE alarm) AS mean_alarms FROM walk WHERE pos >= 0 GROUP BY client),
e AS (SELECT client, CAST(sum(least(starts, 1000) * 5) AS BIGINT) AS e_tests, count(*) FILTER (WHERE alarm) AS e_alarms FROM e_walk WHERE pos >= 0 GROUP BY client)
SELECT client, mean_tests, mean_alarms, e_tests, e_alarms FROM h JOIN e USING (client)""")
def det_13(spark, sf):
    """Comparisons as the steps count them: two levels of the Hoeffding test (the looser one only without an alarm), starts times rates of
    the e-process."""
    s = _s(spark, sf)
    means = detectors.hypotheses(s, detectors.HoeffdingMean, name="mean_tests").withColumnRenamed("alarms", "mean_alarms")
    bets = detectors.hypotheses(s, lambda: detectors.EProcess(0.15), name="e_tests").withColumnRenamed("alarms", "e_alarms")
    return means.join(bets, "client")


@query("det_13_window_cuts")
def det_13b(spark, sf):
    """Cuts that the adaptive window tests, which depend on what it still holds."""
    return detectors.hypotheses(_s(spark, sf), detectors.AdaptiveWindow)


@query("det_9_baselines", STREAM_SQL + "SELECT client, least(greatest(round(avg(loss), 6), 0.01), 1 - 1e-6) AS baseline FROM stream WHERE concept = 0 GROUP BY client")
def det_9(spark, sf):
    return _s(spark, sf).where("concept = 0").groupBy("client").agg(F.least(F.greatest(F.round(F.avg("loss"), 6), F.lit(0.01)), F.lit(1 - 1e-6)).alias("baseline"))


_DELAY = 30


@query("det_9_reset_baselines", STREAM_SQL + f""", past AS MATERIALIZED (SELECT client, pos, loss, sum(loss) OVER w / count(*) OVER w AS mean FROM stream WINDOW w AS (PARTITION BY client ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND {_DELAY} PRECEDING)),
walk AS (
SELECT client, -1 AS pos, {', '.join(f'0.0::DOUBLE AS s{i}' for i in range(5))}, CAST(0 AS BIGINT) AS seen, false AS alarm, 0.01::DOUBLE AS base, 0.01::DOUBLE AS was FROM past WHERE pos = 0
UNION ALL
SELECT client, pos, {', '.join(f'CASE WHEN alarm THEN 0 ELSE s{i} END' for i in range(5))}, seen, alarm, CASE WHEN alarm THEN least(1 - 1e-6, greatest(0.01, coalesce(mean, 0.01))) ELSE base END, base
FROM (SELECT *, ({' + '.join(f's{i}' for i in range(5))}) / 5 >= 1000 AS alarm
 FROM (SELECT x.client, x.pos, x.mean, w.base, CASE WHEN w.alarm THEN 1 ELSE w.seen + 1 END AS seen, {', '.join(f'(1 + w.s{i}) * (1 + {r} * (x.loss / w.base - 1)) AS s{i}' for i, r in enumerate(_RATES))}
  FROM walk w JOIN past x ON x.client = w.client AND x.pos = w.pos + 1)))
SELECT client, pos, seen, round(was, 6) AS baseline, round(base, 6) AS "then" FROM walk WHERE alarm""")
def det_9_resets(spark, sf):
    """The baseline is read at each reset, from the values that have left the delay buffer by then."""
    out = detectors.reset_baselines(_s(spark, sf), _DELAY)
    return out.withColumns({c: F.round(c, 6) for c in ("baseline", "then")})


@query("det_10_insurance_check")
def det_10_check(spark, sf):
    """The adaptive window with its insurance: its width chooses the frame of delayed losses that is held against the model's history."""
    return detectors.insure(_s(spark, sf), detectors.AdaptiveWindow, _DELAY).withColumn("history", F.round("history", 6))


def _losses(spark, sf):
    """Losses of three experts; the third comes in at position 300."""
    third = F.when(F.col("pos") >= 300, F.abs(F.col("loss") - 0.3))
    return _s(spark, sf).select("client", "pos", F.col("loss").alias("a"), (1 - F.col("loss")).alias("b"), third.alias("c"))


def _adahedge(experts: str, losses: str, name: str = "hedge", redone: str = "") -> str:
    """A recursion over positions as SQL: evidence and mixability gap of each client's experts (columns of ``losses``) after its row, weights before it;
    experts whose loss is null aren't there, and all evidence is cleared where their set changes. Table ``redone`` holds evidence, gap and recent sums
    ``r_`` of some positions: evidence becomes that where the expert of least evidence isn't one of least recent sum."""
    e = list(experts)
    here = lambda x, no: f"CASE WHEN {x} IS NULL THEN {no} "
    total = lambda form, by=" + ": by.join(form.format(x=x) for x in e)
    return f"""{name} AS (
SELECT client, -1 AS pos, CAST(0 AS BIGINT) AS there, {total('0.0::DOUBLE AS l_{x}', ', ')}, 0.0::DOUBLE AS gap, {total('0.0::DOUBLE AS w_{x}', ', ')}, 0.0::DOUBLE AS mixture FROM ({losses}) WHERE pos = 0
UNION ALL
SELECT {_redone(e, redone) if redone else '*'} FROM (SELECT client, pos, there, {total('l_{x} + coalesce({x}, 0) AS l_{x}', ', ')}, gap + greatest(0.0, mixture - mix) AS gap, {total('w_{x}', ', ')}, mixture
FROM (SELECT *, {total('w_{x} * coalesce({x}, 0)')} AS mixture,
  CASE WHEN there = 1 OR gap <= 0 THEN least({total('CASE WHEN w_{x} > 0 THEN {x} END', ', ')}) ELSE -ln({total("CASE WHEN w_{x} > 0 THEN w_{x} * exp(-ln(there) / gap * {x}) ELSE 0 END")}) / (ln(there) / gap) END AS mix
 FROM (SELECT *, {total('r_{x} / (' + total('r_{x}') + ') AS w_{x}', ', ')}
  FROM (SELECT *, {', '.join(here(x, '0.0') + f"WHEN there = 1 OR gap <= 0 THEN CAST(l_{x} = low AS DOUBLE) ELSE exp(-ln(there) / gap * (l_{x} - low)) END AS r_{x}" for x in e)}
   FROM (SELECT *, least({', '.join(here(x, 'NULL') + f'ELSE l_{x} END' for x in e)}) AS low
    FROM (SELECT client, pos, there, {total('{x}', ', ')}, {total('CASE WHEN fresh THEN 0.0 ELSE l_{x} END AS l_{x}', ', ')}, CASE WHEN fresh THEN 0.0 ELSE gap END AS gap
     FROM (SELECT x.client, x.pos, {total('CAST(x.{x} IS NOT NULL AS BIGINT)')} AS there, {total('x.{x}', ', ')}, {total('h.l_{x}', ', ')}, h.gap, h.there <> {total('CAST(x.{x} IS NOT NULL AS BIGINT)')} AS fresh
       FROM {name} h JOIN ({losses}) x ON x.client = h.client AND x.pos = h.pos + 1))))))) q {f'LEFT JOIN {redone} r ON r.client = q.client AND r.pos = q.pos' if redone else ''})"""


def _redone(experts: list[str], table: str) -> str:
    least = f"least({', '.join(f'r.r_{x}' for x in experts)})"
    old = "CASE " + " ".join(f"WHEN round(q.l_{x}, 9) <= least({', '.join(f'round(q.l_{y}, 9)' for y in experts)}) THEN r.r_{x}" for x in experts) + " END"
    pick = lambda c: f"CASE WHEN {old} > {least} THEN r.{c} ELSE q.{c} END AS {c}"
    return ", ".join(["q.client", "q.pos", "q.there", *[pick(f"l_{x}") for x in experts], pick("gap"), *[f"q.w_{x}" for x in experts], "q.mixture"])


_TWO = "SELECT client, pos, loss AS a, 1 - loss AS b FROM stream"
_THREE = "SELECT client, pos, loss AS a, 1 - loss AS b, CASE WHEN pos >= 300 THEN abs(loss - 0.3) END AS c FROM stream"


@query("exp_1_adahedge", STREAM_SQL + f""", {_adahedge('abc', _THREE)}
SELECT client, pos, round(w_a, 6) AS w_a, round(w_b, 6) AS w_b, round(w_c, 6) AS w_c, round(mixture, 6) AS mixture, round(1 / (w_a * w_a + w_b * w_b + w_c * w_c), 6) AS effective,
CASE WHEN w_a >= w_b AND w_a >= w_c THEN 'a' WHEN w_b >= w_c THEN 'b' ELSE 'c' END AS leader FROM hedge WHERE pos >= 0""")
def exp_1(spark, sf):
    """EXP-1, EXP-2, EXP-4: weights, mixture loss and effective number of experts before each update."""
    out = experts.route(_losses(spark, sf), lambda: experts.AdaHedge(bounded=False), ["a", "b", "c"], ["client"], "pos")
    return out.withColumns({c: F.round(c, 6) for c in ("w_a", "w_b", "w_c", "mixture", "effective")})


@query("exp_3_fixed_share", STREAM_SQL + f""", x AS ({_TWO}), walk AS (SELECT client, -1 AS pos, 0.5::DOUBLE AS wa, 0.0::DOUBLE AS v, 0.0::DOUBLE AS mix, 0.5::DOUBLE AS nxt FROM x WHERE pos = 0
UNION ALL SELECT client, pos, w, v2, m, (29.0 / 30) * (w * exp(-eta * a) / (w * exp(-eta * a) + (1 - w) * exp(-eta * b))) + (1.0 / 30) / 2
FROM (SELECT *, least(1.0, sqrt(2 * ln(2) / greatest(v2, 1e-12))) AS eta FROM (SELECT x.client, x.pos, a, b, k.nxt AS w, k.nxt * a + (1 - k.nxt) * b AS m,
  k.v + k.nxt * (a - (k.nxt * a + (1 - k.nxt) * b)) ** 2 + (1 - k.nxt) * (b - (k.nxt * a + (1 - k.nxt) * b)) ** 2 AS v2
  FROM walk k JOIN x ON x.client = k.client AND x.pos = k.pos + 1)))
SELECT client, pos, round(wa, 6) AS w_a, round(mix, 6) AS mixture FROM walk WHERE pos >= 0""")
def exp_3(spark, sf):
    """Two experts over all positions."""
    return _fixed_share(_losses(spark, sf))


def _fixed_share(losses):
    out = experts.route(losses, lambda: experts.FixedShare(30, bounded=False), ["a", "b"], ["client"], "pos")
    return out.select("client", "pos", F.round("w_a", 6).alias("w_a"), F.round("mixture", 6).alias("mixture"))


@query("exp_6_routed_summary", STREAM_SQL + f""", {_adahedge('abc', _THREE)}, led AS (SELECT *, CASE WHEN w_a >= w_b AND w_a >= w_c THEN 'a' WHEN w_b >= w_c THEN 'b' ELSE 'c' END AS leader FROM hedge WHERE pos >= 0)
SELECT client, round(avg(mixture), 6) AS mixture, round(least(avg(a), avg(b)), 6) AS best_single, round(avg(least(a, b, coalesce(c, 1.0))), 6) AS oracle, count(DISTINCT leader) AS leaders
FROM led JOIN ({_THREE}) x USING (client, pos) GROUP BY client""")
def exp_6(spark, sf):
    """Mixture against the best single expert and the oracle, for each client."""
    rows = _losses(spark, sf)
    routed = experts.route(rows, lambda: experts.AdaHedge(bounded=False), ["a", "b", "c"], ["client"], "pos").select("client", "pos", "mixture", "leader")
    both = rows.join(routed, ["client", "pos"])
    return both.groupBy("client").agg(
        F.round(F.avg("mixture"), 6).alias("mixture"), F.round(F.least(F.avg("a"), F.avg("b")), 6).alias("best_single"), F.round(F.avg(F.least("a", "b", F.coalesce("c", F.lit(1.0)))), 6).alias("oracle"),
        F.countDistinct("leader").alias("leaders"),
    )


@query("exp_7_protected_gate", STREAM_SQL + f""", {_adahedge('ab', _TWO)}, x AS ({_TWO}),
past AS (SELECT client, pos, a, coalesce(sum(a) OVER w, 0) AS la, coalesce(sum(b) OVER w, 0) AS lb FROM x WINDOW w AS (PARTITION BY client ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
gated AS (SELECT client, a, h.mixture, w_a * la + w_b * lb < la - 1e-9 AS mixed FROM past JOIN hedge h USING (client, pos))
SELECT client, count(*) AS n, count(*) FILTER (WHERE mixed) AS mixed, round(avg(CASE WHEN mixed THEN mixture ELSE a END), 6) AS loss FROM gated GROUP BY client""")
def exp_7(spark, sf):
    """The router's mixture serves only where its weights' past loss is strictly below that of the current model (a); else that model alone."""
    rows = _losses(spark, sf).select("client", "pos", "a", "b")
    past = Window.partitionBy("client").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.select("client", "pos", "a", *[F.coalesce(F.sum(e).over(past), F.lit(0.0)).alias(f"l{e}") for e in "ab"])
    routed = experts.route(rows, lambda: experts.AdaHedge(bounded=False), ["a", "b"], ["client"], "pos").select("client", "pos", "w_a", "w_b", "mixture")
    mixed = F.col("w_a") * F.col("la") + F.col("w_b") * F.col("lb") < F.col("la") - 1e-9
    gated = sums.join(routed, ["client", "pos"]).select("client", "a", "mixture", mixed.alias("mixed"))
    return gated.groupBy("client").agg(F.count("*").alias("n"), F.count(F.when(F.col("mixed"), 1)).alias("mixed"), F.round(F.avg(F.when(F.col("mixed"), F.col("mixture")).otherwise(F.col("a"))), 6).alias("loss"))


_EVIDENCE = STREAM_SQL + """, x AS (SELECT client, pos // 50 AS round, pos, loss AS a, 0.45 AS b FROM stream),
r AS (SELECT client, round, round(sum(a), 9) AS a, round(sum(b), 9) AS b, round(sum(a) FILTER (WHERE pos % 50 >= 20), 9) AS fa, round(sum(b) FILTER (WHERE pos % 50 >= 20), 9) AS fb,
  round(sum(a - b) FILTER (WHERE pos % 50 BETWEEN 20 AND 34), 9) AS early, round(sum(a - b) FILTER (WHERE pos % 50 >= 35), 9) AS late FROM x GROUP BY ALL),
o AS (SELECT *, CASE WHEN sum(a) OVER w <= sum(b) OVER w THEN 'a' ELSE 'b' END AS old, CASE WHEN fa <= fb THEN 'a' ELSE 'b' END AS lead FROM r WINDOW w AS (PARTITION BY client ORDER BY round))"""


@query("exp_8_recalibration", _EVIDENCE + """SELECT client, round, old, lead, old <> lead AS replay,
coalesce(old <> lead AND CASE WHEN lead = 'a' THEN early < 0 AND late < 0 ELSE early > 0 AND late > 0 END, false) AS both_halves FROM o WHERE fa IS NOT NULL""")
def exp_8(spark, sf):
    """After each aggregation round: is the evidence rebuilt from the round's last thirty losses?"""
    s = _all(spark, sf).select("client", F.floor(F.col("pos") / 50).alias("round"), "pos", F.col("loss").alias("a"), F.lit(0.45).alias("b"))
    stored = s.where("pos % 50 >= 20").withColumn("half", F.when(F.col("pos") % 50 >= 35, 1).otherwise(0))
    return experts.recalibration(s, stored, ["a", "b"], "client", "round")
