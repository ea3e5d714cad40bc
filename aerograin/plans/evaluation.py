"""Queries of the experiments: score cube, boundary sweeps, fault benchmark, calibration, resampling, paired tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import FuzzyConfig
from ..functions import fuzzy, scores, stats
from ..operators import evaluate
from ..session import Scratch
from ..sources.adapters import table
from . import hourly, sensor

R = lambda *c, n=6: [F.round(x, n).alias(x) for x in c]
DIFFS = ("mean_abs", "median_abs", "p95_abs", "max_abs", "signed", "agreement")


def score_cube(spark, sf_dir):
    """Differences between the methods over the 11 x 11 x 11 cube of component scores."""
    return evaluate.pair_differences(evaluate.score_methods(evaluate.cube(spark, 11))).select("method_a", "method_b", "n", *R(*DIFFS, n=5))


def cube_masking(spark, sf_dir):
    """Triples with a critical component and how often the mean hides it; boundary buckets of the largest score, one scan."""
    x = evaluate.score_methods(evaluate.cube(spark, 11)).withColumn("top", F.greatest("a", "v", "m"))
    near = lambda b: F.count_if(F.abs(F.col("top") - b) <= 5).alias(f"n_near_{b}")
    return x.agg(F.count_if(F.expr("top >= 75")).alias("n_critical"), F.count_if(F.expr("top >= 75 and sev_mean < 3")).alias("n_masked_mean"), F.count_if(F.expr("top >= 75 and sev_two_level < 3")).alias("n_masked_two_level"), near(25), near(50), near(75))


def random_triples(spark, sf_dir):
    """Hash-drawn score triples off the boundaries (rejected within 1e-6), a row an event: differences between the methods."""
    u = lambda k: (F.conv(F.substring(F.md5(F.concat(F.lit(f"{k}:"), F.col("event_id").cast("string"))), 1, 8), 16, 10).cast("bigint").cast("double") / 4294967296.0) * 100
    x = table(spark, sf_dir, "events").select(u("a").alias("a"), u("v").alias("v"), u("m").alias("m"))
    for c in ("a", "v", "m"):
        for b in (25, 50, 75):
            x = x.where(F.abs(F.col(c) - b) > 1e-6)
    return evaluate.pair_differences(evaluate.score_methods(x)).select("method_a", "method_b", "n", *R(*DIFFS, n=5))


def continuity_summary(spark, sf_dir):
    cols = ("max_jump", "mean_jump", "median_jump", "p95_jump", "variation", "steepest", "spread", "area")
    return evaluate.continuity(evaluate.swept(spark)).select("boundary", "channel", "context", "method", *R(*cols), "n_changes", "n_drops")


def continuity_smoothness(spark, sf_dir):
    s = evaluate.continuity(evaluate.swept(spark))
    return evaluate.smoother(s, "CRISP_MAX").unionByName(evaluate.smoother(s, "FUZZY_MAX")).unionByName(evaluate.smoother(s, "MEAN"))


def reference_cases(spark, sf_dir):
    """Labelled single-input cases around each boundary: severity by the label rule against the fuzzy class with most degree."""
    cfg = FuzzyConfig()
    rows = [(b, c, p, v + d) for b, c, p, v in evaluate.boundaries(cfg) if p == "kitchen_cold" for d in (-1e-3, 1e-3)]
    x = spark.createDataFrame(rows, "boundary string, channel string, profile string, value double")
    v = F.col("value")
    one = {c: (scores.hard_class(v, getattr(cfg, c)[0], False), fuzzy.memberships(v, fuzzy.monotonic_shapes(*getattr(cfg, c)))) for c in ("pm2_5", "pm10", "co2")}
    one |= {c: (scores.hard_class_two_sided(v, getattr(cfg, c)[0]), fuzzy.memberships(v, fuzzy.two_sided_shapes(*getattr(cfg, c)))) for c in ("humidity", "temperature")}
    label = F.coalesce(*[F.when(F.col("channel") == c, k[0]) for c, k in one.items()])
    best = F.coalesce(*[F.when(F.col("channel") == c, F.array_max(F.array(*[F.struct(d.alias("d"), F.lit(s).alias("s")) for s, d in enumerate(k[1])]))["s"]) for c, k in one.items()])
    y = x.withColumns({"label": label, "fuzzy": best})
    return stats.agreement(y, ["channel"], "label", "fuzzy", 4).select("channel", "n", "n_excluded", *R("agreement", "kappa", "macro_f1"))


def fault_detection(spark, sf_dir):
    """Row-level detection of each fault kind, per split."""
    m = evaluate.detection_metrics(evaluate.benchmark(spark), F.array_contains("reasons", F.col("code")), ["split"])
    return m.select("split", "code", "tp", "fp", "fn", "tn", *R("precision", "recall", "f1", "fpr", "specificity"))


def fault_exclusion(spark, sf_dir):
    """The same for the final decision: a row counts as found where it ends up unusable."""
    m = evaluate.detection_metrics(evaluate.benchmark(spark), ~F.col("usable"), ["split"])
    return m.select("split", "code", "tp", "fp", "fn", "tn", *R("precision", "recall", "f1", "fpr", "specificity"))


def fault_events(spark, sf_dir):
    return evaluate.match_events(evaluate.benchmark(spark)).select("split", "code", "n_true", "n_found", "n_predicted", F.round("mean_delay", 6).alias("mean_delay"))


def fault_confusion(spark, sf_dir):
    """True label against every predicted one (none where nothing is predicted)."""
    x = evaluate.benchmark(spark).select("split", F.coalesce("truth", F.lit("none")).alias("truth"), F.explode(F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("none")))).alias("predicted"))
    return x.groupBy("split", "truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def genuine_recovery(spark, sf_dir):
    """Real events: share wrongly left out, and share of suspects recovered by confirmation."""
    x = evaluate.benchmark(spark).where("truth = 'genuine_event'")
    return x.groupBy("split", "channel").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((~F.col("usable")).cast("int")), 6).alias("false_rejection"), F.round(F.try_divide(F.count_if(F.col("confirmed")), F.count_if(F.col("stage2") == "SUSPECT")), 6).alias("recovery"))


def hampel_calibration(spark, sf_dir):
    return evaluate.calibrate_hampel(spark).select("split", "window", "k", *R("recall", "fpr", "kept", "objective"))


def hampel_choice(spark, sf_dir):
    return evaluate.best_hampel(evaluate.calibrate_hampel(spark)).select("window", "k", *R("objective"))


def boundary_nearest(spark, sf_dir):
    """The twenty windows nearest to a class boundary."""
    return evaluate.nearest_boundary(sensor.windows(spark, sf_dir)).select("device", "tick", F.round("distance", 6).alias("distance"))


def stability(spark, sf_dir):
    """Thirty perturbed trials of those windows: how often the class changes, with Wilson bounds, and how far the index moves."""
    base = Scratch(spark, "stability").keep(evaluate.nearest_boundary(sensor.windows(spark, sf_dir)).drop("distance"), "base")
    before = fuzzy.infer(base).select("device", "tick", F.col("index_value").alias("index0"), F.col("index_class").alias("class0"))
    after = fuzzy.infer(evaluate.perturbed(base)).join(before, ["device", "tick"]).where("index_value is not null and index0 is not null")
    d = F.abs(F.col("index_value") - F.col("index0"))
    worse = scores.severity(F.col("index_class")) - scores.severity(F.col("class0"))
    x = after.groupBy("device").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("index_class") != F.col("class0")).alias("k"), F.count_if(worse > 0).alias("n_worse"), F.count_if(worse < 0).alias("n_better"), F.avg(d).alias("mean_shift"), F.percentile(d, 0.95).alias("p95_shift"), F.max(d).alias("max_shift"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return x.withColumns({"low": lo, "high": hi}).select("device", "n", "k", "n_worse", "n_better", *R("mean_shift", "p95_shift", "max_shift", "low", "high"))


def trial_flapping(spark, sf_dir):
    """Class changes along each window's sequence of trials."""
    base = Scratch(spark, "flapping").keep(evaluate.nearest_boundary(sensor.windows(spark, sf_dir)).drop("distance"), "base")
    x = fuzzy.infer(evaluate.perturbed(base)).where("index_class is not null")
    w = Window.partitionBy("device", "tick").orderBy("trial")
    return x.withColumn("turn", F.col("index_class") != F.lag("index_class").over(w)).groupBy("device", "tick").agg(F.count(F.lit(1)).alias("n"), F.count_if("turn").alias("n_turns"))


def stratified_sample(spark, sf_dir):
    """Up to five hours of every class, home and season, drawn by hash."""
    x = hourly.indexed(spark, sf_dir).where(scores.complete())
    return evaluate.hash_sample(x, ["home", "time"], ["home", "class_I"], 5).select("home", "time", "class_I", F.round("I", 6).alias("I"))


def day_split(spark, sf_dir):
    """Whole days dealt to train (70 %) and test within each home and month, by hash of the day."""
    days = hourly.grid(spark, sf_dir).select("home", F.to_date("time").alias("day"), F.month("time").alias("month")).distinct()
    w = Window.partitionBy("home", "month")
    k = F.row_number().over(w.orderBy(F.md5(F.concat_ws(":", F.col("home").cast("string"), F.col("day").cast("string"))), "day"))
    x = days.withColumn("part", F.when(k <= F.round(0.7 * F.count(F.lit(1)).over(w)), "train").otherwise("test"))
    return x.groupBy("home", "month", "part").agg(F.count(F.lit(1)).alias("n_days"), F.min("day").alias("first"))


def window_sensitivity(spark, sf_dir):
    """Slots, matches and coverage for windows of 5, 15, 30 and 60 minutes."""
    out = None
    for m in (5, 15, 30, 60):
        e = sensor.expected(spark, sf_dir, m).where("is_window").groupBy("device", "tick").agg(F.count(F.lit(1)).alias("n"), F.count_if("matched").alias("k"))
        x = e.agg(F.lit(m).alias("minutes"), F.count(F.lit(1)).alias("n_windows"), F.count_if(F.col("k") / F.col("n") >= 0.8).alias("n_ok"))
        out = x if out is None else out.unionByName(x)
    return out


def bootstrap_error(spark, sf_dir):
    """Mean error of the three-hour persistence forecast with a 95 % interval over resampled days."""
    from ..operators import features

    x = features.targets(hourly.indexed(spark, sf_dir), ["I"], (3,)).where("I is not null and I__h3 is not null")
    y = x.select(F.concat_ws("/", F.col("home").cast("string"), F.to_date("time").cast("string")).alias("day"), F.abs(F.col("I__h3") - F.col("I")).alias("e"), F.lit(1.0).alias("one"))
    return stats.bootstrap(y, "day", "e", "one", 200).select(*R("estimate", "low", "high"))


def paired_tests(spark, sf_dir):
    """Does the index differ from the plain mean? Per home: signed ranks of day means, exact McNemar on critical hours, Holm over all of them."""
    x = hourly.indexed(spark, sf_dir).where(scores.complete())
    day = x.groupBy("home", F.to_date("time").alias("day")).agg((F.avg("I") - F.avg("Q_mean")).alias("d"), F.count_if((F.col("class_I") >= 3) & (scores.class_of_score(F.col("Q_mean")) < 3)).alias("b"), F.count_if((F.col("class_I") < 3) & (scores.class_of_score(F.col("Q_mean")) >= 3)).alias("c"))
    ranks = stats.signed_ranks(day, ["home"], "d")
    t = day.groupBy("home").agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    both = ranks.join(t, "home").withColumn("q", stats.mcnemar_p(F.col("b"), F.col("c")))
    long = both.select("home", "n", "b", "c", "statistic", F.expr("stack(2, 'ranks', p_wilcoxon, 'discordant', q) as (test, p)"))
    out = stats.holm(long.withColumn("one", F.lit(1)), ["one"], "p")
    return out.select("home", "test", "n", "b", "c", *R("statistic", "p", "p_holm"))


def holm_adjusted(spark, sf_dir):
    """Step-down adjustment of the p-values implied by each event type's share (an even numeric table to adjust)."""
    e = table(spark, sf_dir, "events")
    p = e.groupBy("event_type", (F.col("user_id") % 5).alias("g")).agg((F.count(F.lit(1)) / 100000.0).alias("p"))
    return stats.holm(p, ["g"], "p").select("g", "event_type", F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"))


QUERIES = {f.__name__: f for f in (score_cube, cube_masking, random_triples, continuity_summary, continuity_smoothness, reference_cases, fault_detection, fault_exclusion, fault_events, fault_confusion, genuine_recovery, hampel_calibration, hampel_choice, boundary_nearest, stability, trial_flapping, stratified_sample, day_split, window_sensitivity, bootstrap_error, paired_tests, holm_adjusted)}

# --- SQL -------------------------------------------------------------------------------------------------------------


def _methods(source: str) -> str:
    """CTE `sm`: a, v, m and the four methods with severities; all 64 rules listed."""
    shapes = fuzzy.monotonic_shapes(*FuzzyConfig().output)
    mem = ", ".join(f"{sensor._trap(c, shapes[s][0])} AS {c}{s}" for c in "avm" for s in range(4))
    act = ", ".join(f"greatest({', '.join(f'least(a{i}, v{j}, m{k})' for i in range(4) for j in range(4) for k in range(4) if max(i, j, k) == s)}) AS o{s}" for s in range(4))
    return f"""uni AS (SELECT i * 0.25::DOUBLE AS u FROM (SELECT unnest(range(0, 401)) AS i)), s0 AS (SELECT row_number() OVER () AS k, a, v, m FROM {source}), s1 AS (SELECT *, {mem} FROM s0), s2 AS (SELECT *, {act} FROM s1),
{sensor._centre('s2', ['o0', 'o1', 'o2', 'o3'], 's3', 'k')}, s4 AS (SELECT k, a, v, m, c AS two_level, greatest(a, v, m) AS fuzzy_max, (a + v + m) / 3 AS mean FROM s2 JOIN s3 USING (k)),
s5 AS (SELECT *, {sensor.sev_sql('fuzzy_max')} * 25.0::DOUBLE + 12.5 AS crisp_max FROM s4), sm AS (SELECT *, {', '.join(f'{sensor.sev_sql(c)} AS sev_{c}' for c in ('two_level', 'fuzzy_max', 'crisp_max', 'mean'))} FROM s5)"""


def _differences() -> str:
    m = ("two_level", "fuzzy_max", "crisp_max", "mean")
    rows = " UNION ALL ".join(f"SELECT '{a}' AS method_a, '{b}' AS method_b, {a} AS x, {b} AS y, sev_{a} AS sx, sev_{b} AS sy FROM sm" for i, a in enumerate(m) for b in m[i + 1 :])
    return f"""SELECT method_a, method_b, count(*) AS n, round(avg(abs(x - y)), 5) AS mean_abs, round(quantile_cont(abs(x - y), 0.5), 5) AS median_abs, round(quantile_cont(abs(x - y), 0.95), 5) AS p95_abs, round(max(abs(x - y)), 5) AS max_abs, round(avg(x - y), 5) AS signed, round(avg((sx = sy)::INT), 5) AS agreement FROM ({rows}) GROUP BY method_a, method_b"""


_CUBE = "l AS (SELECT unnest(range(11)) * 10.0::DOUBLE AS x), cube AS (SELECT p.x AS a, q.x AS v, r.x AS m FROM l p CROSS JOIN l q CROSS JOIN l r)"
_U = lambda k: f"('0x' || substr(md5('{k}:' || event_id), 1, 8))::BIGINT::DOUBLE / 4294967296.0 * 100"
_OFF = " AND ".join(f"abs({c} - {b}) > 1e-6" for c in "avm" for b in (25, 50, 75))


def _scenario_sql() -> str:
    rows = ", ".join(f"('{c}', '{k}', {v}, {s}::DOUBLE, {evaluate.SCENARIOS[c][0]}::DOUBLE, {evaluate.SCENARIOS[c][1]}::DOUBLE)" for c, k, v, s, _ in evaluate.scenario_kinds())
    rip = lambda step, ph="0.0": f"0.3 * swing * sin(2 * pi() * {step} / 5.0::DOUBLE + {ph})"
    spike, event = "kind LIKE 'single_spike%'", "kind IN ('genuine_rapid_event', 'persistent_real_change')"
    return f"""sd AS (SELECT * FROM (VALUES {rows}) t(channel, kind, variant, size, base, swing)), sp AS (SELECT *, CASE variant WHEN 0 THEN 1.0::DOUBLE ELSE 1.15 END AS sc FROM sd CROSS JOIN (SELECT unnest(range({evaluate.POINTS}))::INT AS i)),
sv AS (SELECT *, CASE variant WHEN 0 THEN 'calibration' ELSE 'validation' END AS split,
 CASE WHEN {spike} AND i = 20 THEN base + size * sc WHEN kind = 'out_of_range' AND i = 20 THEN size WHEN kind = 'stuck_value' AND i BETWEEN 20 AND 27 THEN size WHEN kind = 'data_loss' AND i BETWEEN 20 AND 24 THEN NULL
  WHEN kind = 'gradual_drift' AND i BETWEEN 20 AND 29 THEN base + size * sc * (i - 19) WHEN kind = 'genuine_rapid_event' AND i >= 20 THEN base + size * sc + {rip('(i - 20)')}
  WHEN kind = 'persistent_real_change' AND i >= 20 THEN base + least(size * sc * 2 / 3, size * sc / 10 * (i - 19)) + {rip('(i - 20)')} ELSE base + swing * sin(2 * pi() * (i + CASE variant WHEN 0 THEN 0 ELSE 3 END) / 7.0::DOUBLE) END AS value,
 CASE WHEN {spike} AND i = 20 THEN 'single_spike' WHEN kind = 'out_of_range' AND i = 20 THEN 'out_of_range' WHEN kind = 'stuck_value' AND i BETWEEN 20 AND 27 THEN 'stuck_value' WHEN kind = 'data_loss' AND i BETWEEN 20 AND 24 THEN 'data_loss'
  WHEN kind = 'gradual_drift' AND i BETWEEN 20 AND 29 THEN 'gradual_drift' WHEN {event} AND i >= 20 THEN 'genuine_event' END AS truth FROM sp),
checked AS (SELECT channel || '_' || kind || '_' || split AS device, 0 AS tick, i AS slot, channel, split, truth, value, true AS is_window,
 CASE WHEN value IS NULL THEN 'MISSING' WHEN NOT (CASE channel {' '.join(f"WHEN '{c}' THEN value BETWEEN {sensor.CHANNELS[c][0]} AND {sensor.CHANNELS[c][1]}" for c in evaluate.SCENARIOS)} END) THEN 'INVALID' ELSE 'VALID' END AS state,
 NULL::DOUBLE AS aux1, NULL::DOUBLE AS aux2, CASE WHEN channel IN ('temperature', 'humidity') THEN value + {rip('i', '1.7')} END AS secondary, NULL::DOUBLE AS trend,
 CASE WHEN value IS NULL THEN 'data_loss' WHEN NOT (CASE channel {' '.join(f"WHEN '{c}' THEN value BETWEEN {sensor.CHANNELS[c][0]} AND {sensor.CHANNELS[c][1]}" for c in evaluate.SCENARIOS)} END) THEN 'out_of_range' END AS reason FROM sv)"""


_BENCH = f"{_scenario_sql()}, {sensor._SOFT[len(sensor._CHECKED) + 2 :]}"
_CODES = "(SELECT unnest([" + ", ".join(f"'{r}'" for r in evaluate.REASONS) + "]) AS code)"


def _detect(hit: str) -> str:
    return f"""WITH {_BENCH}, x AS (SELECT split, code, {hit} AS p, coalesce(truth = code, false) AS t FROM soft CROSS JOIN {_CODES}),
c AS (SELECT split, code, count_if(p AND t)::BIGINT AS tp, count_if(p AND NOT t)::BIGINT AS fp, count_if(NOT p AND t)::BIGINT AS fn, count_if(NOT p AND NOT t)::BIGINT AS tn FROM x GROUP BY split, code),
r AS (SELECT *, tp / nullif(tp + fp, 0) AS pr, tp / nullif(tp + fn, 0) AS re, fp / nullif(fp + tn, 0) AS f FROM c)
SELECT split, code, tp, fp, fn, tn, round(pr, 6) AS precision, round(re, 6) AS recall, CASE WHEN pr > 0 AND re > 0 THEN round(2 * pr * re / (pr + re), 6) END AS f1, round(f, 6) AS fpr, round(1 - f, 6) AS specificity FROM r"""


_LIMITS = [(c, getattr(FuzzyConfig(), c)[0]) for c in ("pm2_5", "pm10", "co2", "humidity", "temperature")]
_NEAR = f"least({', '.join(f'abs({c} - {b})' for c, bs in _LIMITS for b in bs)})"

SQL = {
    "score_cube": f"WITH {_CUBE}, {_methods('cube')} {_differences()}",
    "cube_masking": f"WITH {_CUBE}, {_methods('cube')} SELECT count_if(fuzzy_max >= 75)::BIGINT AS n_critical, count_if(fuzzy_max >= 75 AND sev_mean < 3)::BIGINT AS n_masked_mean, count_if(fuzzy_max >= 75 AND sev_two_level < 3)::BIGINT AS n_masked_two_level, {', '.join(f'count_if(abs(fuzzy_max - {b}) <= 5)::BIGINT AS n_near_{b}' for b in (25, 50, 75))} FROM sm",
    "random_triples": f"WITH tr AS (SELECT {_U('a')} AS a, {_U('v')} AS v, {_U('m')} AS m FROM events), ok AS (SELECT * FROM tr WHERE {_OFF}), {_methods('ok')} {_differences()}",
    "fault_detection": _detect("list_contains(reasons, code)"),
    "fault_exclusion": _detect("NOT usable"),
    "fault_confusion": f"WITH {_BENCH}, x AS (SELECT split, coalesce(truth, 'none') AS truth, unnest(CASE WHEN len(reasons) > 0 THEN reasons ELSE ['none'] END) AS predicted FROM soft) SELECT split, truth, predicted, count(*) AS n FROM x GROUP BY ALL",
    "genuine_recovery": f"WITH {_BENCH} SELECT split, channel, count(*) AS n, round(avg((NOT usable)::INT), 6) AS false_rejection, round(count_if(confirmed) / nullif(count_if(stage2 = 'SUSPECT'), 0), 6) AS recovery FROM soft WHERE truth = 'genuine_event' GROUP BY split, channel",
    "boundary_nearest": f"WITH {sensor._AGG}, win AS (SELECT device, tick, {', '.join(f"any_value(mean) FILTER (channel = '{c}') AS {c}" for c in sensor.WIDE)} FROM agg GROUP BY device, tick), d AS (SELECT device, tick, {_NEAR} AS distance FROM win) SELECT device, tick, round(distance, 6) AS distance FROM d WHERE distance IS NOT NULL ORDER BY d.distance, device, tick LIMIT 20",
    "day_split": f"""WITH {hourly.sqltext.GRID}, d AS (SELECT DISTINCT home, time::DATE AS day, month(time)::INT AS month FROM grid), k AS (SELECT *, row_number() OVER (PARTITION BY home, month ORDER BY md5(home || ':' || day), day) AS k, count(*) OVER (PARTITION BY home, month) AS n FROM d),
p AS (SELECT *, CASE WHEN k <= round(0.7 * n) THEN 'train' ELSE 'test' END AS part FROM k) SELECT home, month, part, count(*) AS n_days, min(day) AS first FROM p GROUP BY home, month, part""",
    "holm_adjusted": """WITH p AS (SELECT event_type, user_id % 5 AS g, count(*) / 100000.0::DOUBLE AS p FROM events GROUP BY ALL), r AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY g) - row_number() OVER (PARTITION BY g ORDER BY p) + 1) * p) AS r FROM p)
SELECT g, event_type, round(p, 6) AS p, round(max(r) OVER (PARTITION BY g ORDER BY p ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM r""",
    "hampel_calibration": f"""WITH {_scenario_sql()}, x AS (SELECT *, device AS sid FROM checked WHERE channel = 'co2' AND (device LIKE 'co2_single_spike%' OR device LIKE 'co2_genuine%' OR device LIKE 'co2_persistent%')),
l AS ({' UNION ALL '.join(f"SELECT *, {n} AS win, list(value) OVER (PARTITION BY sid ORDER BY slot ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS l FROM x" for n in (7, 11, 15))}),
a AS (SELECT *, CASE WHEN len(l) = win THEN list_aggregate(l, 'median') END AS med FROM l), b AS (SELECT *, list_aggregate(list_transform(l, lambda y: abs(y - med)), 'median') * 1.4826 AS mad FROM a),
c AS (SELECT split, win, k, coalesce(truth = 'single_spike', false) AS s, coalesce(truth = 'genuine_event', false) AS g, coalesce(CASE WHEN mad > 0 THEN abs(value - med) > k * mad ELSE value <> med END, false) AS f FROM b CROSS JOIN (SELECT unnest([2.5::DOUBLE, 3.0, 3.5]) AS k)),
r AS (SELECT split, win, k, count_if(s AND f) / nullif(count_if(s), 0) AS recall, count_if(NOT s AND f) / nullif(count_if(NOT s), 0) AS fpr, count_if(g AND NOT f) / nullif(count_if(g), 0) AS kept FROM c GROUP BY ALL)
SELECT split, win AS "window", k, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(kept, 6) AS kept, round((recall + kept + 1 - fpr) / 3, 6) AS objective FROM r""",
    "window_sensitivity": " UNION ALL ".join(
        f"""SELECT {m} AS minutes, count(*) AS n_windows, count_if(k / n >= 0.8)::BIGINT AS n_ok FROM (
WITH {sensor._MATCH}, {sensor._TICKS}, sl AS (SELECT device, tick, tick - to_seconds(unnest(range(0, {m * 2})) * 30) AS slot FROM ticks)
SELECT sl.device, sl.tick, count(*) AS n, count(m.slot) AS k FROM sl LEFT JOIN matched m ON m.device = sl.device AND m.slot = sl.slot GROUP BY ALL)"""
        for m in (5, 15, 30, 60)
    ),
}
_NORMAL = lambda z: (lambda t: f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429))))) * exp(-({z}) * ({z}) / 2)")(f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2)))")
_CODE_ROWS = f"ev AS (SELECT split, device AS sid, slot AS i, code, coalesce(truth = code, false) AS t, list_contains(reasons, code) AS p FROM soft CROSS JOIN {_CODES})"
_CLASSED = lambda c, two: "CASE " + " ".join(f"WHEN {m} IS NOT NULL AND {m} = greatest({', '.join(sensor._members(c, two))}) THEN {k}" for k, m in reversed(list(enumerate(sensor._members(c, two))))) + " END"
_LABELS = {c: f"CASE WHEN value <= {b[0]} THEN 0 WHEN value <= {b[1]} THEN 1 WHEN value <= {b[2]} THEN 2 ELSE 3 END" for c, (b, _) in (("pm2_5", FuzzyConfig().pm2_5), ("pm10", FuzzyConfig().pm10), ("co2", FuzzyConfig().co2))} | {c: sensor._hard2("value", e[0]) for c, e in (("humidity", FuzzyConfig().humidity), ("temperature", FuzzyConfig().temperature))}
_SHAPED = {c: fuzzy.monotonic_shapes(*getattr(FuzzyConfig(), c)) for c in ("pm2_5", "pm10", "co2")} | {c: fuzzy.two_sided_shapes(*getattr(FuzzyConfig(), c)) for c in ("humidity", "temperature")}
_CASES = " UNION ALL ".join(f"SELECT '{c}' AS channel, {_LABELS[c]} AS a, {_CLASSED('value', _SHAPED[c])} AS b FROM (VALUES {', '.join(f'({v + d!r}::DOUBLE)' for _, ch, p, v in evaluate.boundaries(FuzzyConfig()) if p == 'kitchen_cold' and ch == c for d in (-1e-3, 1e-3))}) t(value)" for c in _SHAPED)
SQL |= {
    "hampel_choice": f"SELECT \"window\", k, objective FROM ({SQL['hampel_calibration']}) WHERE split = 'calibration' AND \"window\" = 11 ORDER BY objective DESC, recall DESC, kept DESC, fpr, k LIMIT 1",
    "stratified_sample": f"""WITH {hourly.sqltext.GRID}, {hourly.sqltext.index()}, r AS (SELECT home, time, "class_I", "I", row_number() OVER (PARTITION BY home, "class_I" ORDER BY md5('42:' || home || ':' || epoch(time)::BIGINT), home, time) AS r FROM idx WHERE "I" IS NOT NULL) SELECT home, time, "class_I", round("I", 6) AS "I" FROM r WHERE r <= 5""",
    "bootstrap_error": f"""WITH {hourly.sqltext.GRID}, {hourly.sqltext.index()}, e AS (SELECT home || '/' || time::DATE AS day, abs(lead("I", 3) OVER (PARTITION BY home ORDER BY time) - "I") AS e FROM idx), u AS (SELECT day, sum(e) AS v, count(*)::DOUBLE AS w FROM e WHERE e IS NOT NULL GROUP BY day),
c AS (SELECT k, sum(exp(-1.0) / gamma(k + 1)) OVER (ORDER BY k) AS below FROM (SELECT unnest(range(12)) AS k)),
d AS (SELECT r, v, w, (SELECT count(*) FROM c WHERE below < ('0x' || substr(md5('42:' || r || ':' || day), 1, 8))::BIGINT::DOUBLE / 4294967296.0) AS k FROM u CROSS JOIN (SELECT unnest(range(1, 201)) AS r)), s AS (SELECT r, sum(k * v) / sum(k * w) AS s FROM d GROUP BY r)
SELECT round((SELECT sum(v) / sum(w) FROM u), 6) AS estimate, round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high FROM s""",
    "paired_tests": f"""WITH {hourly.sqltext.GRID}, {hourly.sqltext.index()}, x AS (SELECT home, time::DATE AS day, "I", "Q_mean", "class_I" >= 3 AS a, greatest(0, least(4, ceil("Q_mean" / 25.0::DOUBLE)::INTEGER)) >= 3 AS m FROM idx WHERE "I" IS NOT NULL),
d AS (SELECT home, day, avg("I") - avg("Q_mean") AS d, count_if(a AND NOT m) AS b, count_if(m AND NOT a) AS c FROM x GROUP BY home, day), z AS (SELECT home, d, round(abs(d), 9) AS m FROM d WHERE abs(d) > 1e-12),
r AS (SELECT *, count(*) OVER (PARTITION BY home, m) AS same, rank() OVER (PARTITION BY home ORDER BY m) + (count(*) OVER (PARTITION BY home, m) - 1) / 2.0 AS r FROM z),
s AS (SELECT home, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS plus, sum(same * same - 1)::DOUBLE AS ties FROM r GROUP BY home), t AS (SELECT home, sum(b)::BIGINT AS b, sum(c)::BIGINT AS c FROM d GROUP BY home),
v AS (SELECT *, least(plus, n * (n + 1) / 2.0 - plus) AS statistic, n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - ties / 48 AS var FROM s), q AS (SELECT *, (statistic - n * (n + 1) / 4.0) / sqrt(var) AS zz FROM v JOIN t USING (home)),
l AS (SELECT home, n, b, c, statistic, 'ranks' AS test, {_NORMAL('zz')} AS p FROM q UNION ALL SELECT home, n, b, c, statistic, 'discordant', CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END FROM q),
h AS (SELECT *, row_number() OVER (ORDER BY p) AS i, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p) + 1) * p) AS raw FROM l)
SELECT home, test, n, b, c, round(statistic, 6) AS statistic, round(p, 6) AS p, round(max(raw) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM h""",
    "fault_events": f"""WITH {_BENCH}, {_CODE_ROWS}, tr AS (SELECT split, code, sid, min(i) AS a, max(i) AS b FROM ev WHERE t GROUP BY ALL), hp AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY sid, code ORDER BY i) <= 3 THEN 0 ELSE 1 END AS new FROM ev WHERE p),
gp AS (SELECT *, sum(new) OVER (PARTITION BY sid, code ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM hp), pr AS (SELECT split, code, sid, g, min(i) AS pa, max(i) AS pb FROM gp GROUP BY ALL),
mt AS (SELECT t.split, t.code, pa - a AS delay FROM tr t JOIN pr p USING (split, code, sid) WHERE pa <= b + 2 AND pb >= a - 2 QUALIFY row_number() OVER (PARTITION BY t.split, t.code, t.sid ORDER BY abs(pa - a), pa) = 1),
n AS (SELECT split, code, count(*) AS n_true FROM tr GROUP BY ALL), f AS (SELECT split, code, count(*) AS n_found, avg(delay) AS mean_delay FROM mt GROUP BY ALL), q AS (SELECT split, code, count(*) AS n_predicted FROM pr GROUP BY ALL)
SELECT split, code, coalesce(n_true, 0) AS n_true, coalesce(n_found, 0) AS n_found, coalesce(n_predicted, 0) AS n_predicted, round(mean_delay, 6) AS mean_delay FROM n FULL JOIN f USING (split, code) FULL JOIN q USING (split, code)""",
    "reference_cases": f"WITH {sensor.agreement_sql(_CASES, 'channel')}",
}
