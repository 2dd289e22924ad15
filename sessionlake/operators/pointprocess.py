"""Temporal point processes: event tables from coded intervals, inter-event times, Poisson and Hawkes models.

The exponential kernel makes the history of an event a decayed running sum.  Time is cut into tiles of ``30 / beta``
seconds: inside a tile the sum is a plain running sum of bounded exponentials, and a tile passes on to the two after it
one number each (what lies further back weighs less than 1e-26).  So the likelihood needs sums only, never event pairs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.operators.binning import group_quantiles
from sessionlake.operators.ordering import running_sum, time_order
from sessionlake.session import cut_lineage

TILE_DECAY = 30.0
BLOCK = 10_000
SAME_INSTANT = 1e-4


def literal_rows(spark, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """A few driver-side numbers as an inline table."""
    names = [part.split()[0] for part in ddl.split(", ")]
    kinds = [part.split()[1] for part in ddl.split(", ")]
    cell = lambda value, kind: f"CAST('{value}' AS {kind})"
    values = ", ".join("(" + ", ".join(cell(v, k) for v, k in zip(row, kinds)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def column_roles(sheet: DataFrame) -> DataFrame:
    """Role of every column of a coded sheet from its name, and for the rest from the share of numeric cells."""
    patterns = {"rater": "rater|coder|observer", "timestamp": "time|stamp|interval", "notes": "note|notice|comment|qualitative"}
    import re

    roles: dict[str, str] = {}
    for role, pattern in patterns.items():
        hit = next((name for name in sheet.columns if re.search(pattern, name, re.I)), None)
        if hit is not None:
            roles.setdefault(hit, role)
    share = sheet.agg(*[F.avg(F.when(F.col(f"`{name}`").cast("string").try_cast("double").isNotNull(), 1.0).otherwise(0.0)).alias(name) for name in sheet.columns])
    cells = F.explode(F.array(*[F.struct(F.lit(name).alias("column_name"), F.lit(roles.get(name)).cast("string").alias("known"), F.col(f"`{name}`").alias("numeric_share"))
                                for name in sheet.columns])).alias("x")
    role = F.coalesce("known", F.when(F.col("numeric_share") > 0.5, "reward").otherwise("ignored"))
    return share.select(cells).select("x.*").select("column_name", role.alias("role"), "numeric_share")


def interval_events(sheet: DataFrame, keys: Sequence[str], start: str, end: str, types: Sequence[str], *, jitter_seed: int | None = None) -> DataFrame:
    """One row per coded event, spread evenly over its interval (or uniformly at random), in column order.

    Events of a row are told apart by a microsecond each.  Counts are expanded in two steps so that no row ever holds a
    long array.
    """
    offset = F.lit(0).cast("long")
    parts = []
    for name in types:
        n = F.greatest(F.coalesce(F.col(name).cast("long"), F.lit(0)), F.lit(0)).cast("long")
        parts.append(F.struct(F.lit(name).alias("event_type"), n.alias("n"), offset.alias("offset")))
        offset = offset + n
    d = sheet.select(*keys, start, end, F.explode(F.array(*parts)).alias("p")).select(*keys, start, end, "p.*").filter("n > 0")
    d = d.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {BLOCK}"))))
    d = d.withColumn("i", F.explode(F.sequence(F.col("_block") * BLOCK + 1, F.least("n", (F.col("_block") + 1) * BLOCK)))).drop("_block")
    span = F.col(end) - F.col(start)
    place = F.col(start) + (F.rand(jitter_seed) * span if jitter_seed is not None else F.col("i") * span / (F.col("n") + 1))
    return d.select(*keys, "event_type", "i", F.col("n").alias("coded_value"), (place + (F.col("offset") + F.col("i") - 1) * 1e-6).alias("event_time_s"))


def gaps(events: DataFrame, keys: Sequence[str], *, time: str = "t_ms", tie: str = "event_id") -> DataFrame:
    """Seconds to the previous event of the same key, without coincident events."""
    order = time_order(events, keys, (time, tie))
    d = order.untag(order.frames(order.tag(events), 1, _p=lambda w: F.lag(time).over(w)))
    return d.withColumn("gap_s", (F.col(time) - F.col("_p")) / 1000.0).drop("_p").filter(F.col("gap_s") > SAME_INSTANT)


def gap_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    spread = group_quantiles(rows, keys, "gap_s", {"median_s": 0.5}, scale=1_000)
    facts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("gaps"), F.avg("gap_s").alias("mean_s"), F.stddev_pop("gap_s").alias("std_s"),
                                    F.min("gap_s").alias("min_s"), F.max("gap_s").alias("max_s"))
    return facts.join(spread, list(keys))


def gap_histogram(rows: DataFrame, key: str, *, bins: int = 30, share: float = 0.95) -> DataFrame:
    """Histogram of the gaps up to their 95th percentile, in equal bins from the smallest to the largest kept gap."""
    caps = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max("gap_s").alias("_max")).join(
        group_quantiles(rows, [key], "gap_s", {"_q": share}, scale=1_000), key)
    caps = caps.select(key, F.when(F.col("_n") > 5, F.col("_q")).otherwise(F.col("_max")).alias("_cap"))
    kept = rows.join(caps, key).filter(F.col("gap_s") <= F.col("_cap"))
    ends = kept.groupBy(key).agg(F.min("gap_s").alias("low_s"), F.max("gap_s").alias("high_s"))
    d = kept.join(ends, key)
    cell = F.least(F.floor(F.try_divide(F.col("gap_s") - F.col("low_s"), F.col("high_s") - F.col("low_s")) * bins), F.lit(bins - 1)).cast("long")
    return d.groupBy(key, F.coalesce(cell, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def poisson_fit(events: DataFrame, keys: Sequence[str], exposure_s: Column) -> DataFrame:
    """Homogeneous Poisson rate, log-likelihood, AIC and BIC; ``exposure_s`` is an aggregate."""
    d = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), exposure_s.cast("double").alias("exposure_s"))
    rate = F.try_divide(F.col("n"), F.col("exposure_s"))
    d = d.withColumns({"rate": rate, "loglik": F.col("n") * F.log(rate) - F.col("n")})
    return d.withColumns({"aic": 2 - 2 * F.col("loglik"), "bic": F.log("n") - 2 * F.col("loglik")})


def _tiled(points: DataFrame, beta: str, time_ms: str, weights: dict[str, Column]) -> DataFrame:
    """Points with their tile, their weights as seen from its start, and what is left of a weight since then."""
    b = F.col(beta)
    width = TILE_DECAY * 1000.0 / b
    d = points.withColumn("_tile", F.floor(F.col(time_ms) / width).cast("long"))
    age = (F.col(time_ms) - F.col("_tile") * width) / 1000.0
    return d.withColumns({**{f"_w_{name}": weight * F.exp(b * age) for name, weight in weights.items()}, "_fade": F.exp(-b * age)})


def _history_in_place(d: DataFrame, series: Sequence[str], time_ms: str, tie: str, weights: dict[str, Column]) -> DataFrame:
    """The history where no series is too large for a window: what the two tiles before left stands on earlier rows, so rows are shuffled at most once."""
    inside = Window.partitionBy(*series, "_tile").orderBy(time_ms, tie).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*series).orderBy("_tile", time_ms, tie)
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({f"_r_{name}": F.coalesce(F.sum(f"_w_{name}").over(inside), F.lit(0.0)) for name in weights})
    left = F.struct(F.col("_tile").alias("tile"), *[((F.col(f"_r_{name}") + F.col(f"_w_{name}")) * math.exp(-TILE_DECAY)).alias(name) for name in weights])
    d = d.withColumn("_left", F.lag(left).over(along))
    opens = F.col("_left").isNotNull() & (F.col("_left.tile") != F.col("_tile"))
    d = d.withColumn("_one", F.last(F.when(opens, F.col("_left")), ignorenulls=True).over(so_far))  # the tile before with points, null in the first
    d = d.withColumn("_lag", F.lag("_one").over(along))
    d = d.withColumn("_two", F.last(F.when(opens, F.struct(F.col("_lag").alias("before"))), ignorenulls=True).over(so_far))
    at = lambda tile, name, back: F.when(F.col(f"{tile}.tile") == F.col("_tile") - back, F.col(f"{tile}.{name}")).otherwise(0.0)
    far = math.exp(-TILE_DECAY)
    out = {name: F.col("_fade") * (F.col(f"_r_{name}") + at("_one", name, 1) + far * (at("_one", name, 2) + at("_two.before", name, 2))) for name in weights}
    return d.withColumns(out).drop("_tile", "_fade", "_left", "_one", "_lag", "_two", *[f"_{p}_{name}" for p in "wr" for name in weights])


def decayed_history(points: DataFrame, keys: Sequence[str], beta: str, *, time_ms: str = "t_ms", tie: str = "event_id",
                    weights: dict[str, Column] | None = None, small: bool | None = None) -> DataFrame:
    """For each point and weight the sum of ``w * exp(-beta * age)`` over the earlier points of its keys.

    ``beta`` names a column; it is part of the series.  ``weights`` maps output names to weights (default: one).
    ``small`` says whether every series is known to fit a window (default: they are counted); points that lie by ``keys`` are then not shuffled again.
    """
    weights = weights or {"history": F.lit(1.0)}
    series = [*keys, beta]
    if small is None:
        small = not time_order(points, series, (time_ms, tie)).split
        points = points.repartition(*keys) if small else points
    d = _tiled(points, beta, time_ms, weights)
    if small:
        return _history_in_place(d, series, time_ms, tie, weights)
    order = time_order(d, [*series, "_tile"], (time_ms, tie))
    d = order.untag(order.running(order.tag(d), **{f"_r_{name}": running_sum(F.col(f"_w_{name}"), exclusive=True) for name in weights}))
    # what a tile leaves at its end reaches the next tile in full and the one after faded by a whole tile
    left = d.groupBy(*series, "_tile").agg(*[(F.sum(f"_w_{name}") * math.exp(-TILE_DECAY)).alias(f"_s_{name}") for name in weights])
    reach = F.explode(F.array(F.struct(F.lit(1).alias("k"), F.lit(1.0).alias("f")), F.struct(F.lit(2).alias("k"), F.lit(math.exp(-TILE_DECAY)).alias("f")))).alias("x")
    carry = left.select(*series, "_tile", *[f"_s_{name}" for name in weights], reach).groupBy(*series, (F.col("_tile") + F.col("x.k")).alias("_tile")).agg(
        *[F.sum(F.col(f"_s_{name}") * F.col("x.f")).alias(f"_c_{name}") for name in weights])
    d = d.join(carry, [*series, "_tile"], "left")
    zero = F.lit(0.0)
    out = {name: F.col("_fade") * (F.coalesce(f"_r_{name}", zero) + F.coalesce(f"_c_{name}", zero)) for name in weights}
    return d.withColumns(out).drop("_tile", "_fade", *[f"_{p}_{name}" for p in "wrc" for name in weights])


def with_decay_rates(events: DataFrame, betas: Sequence[float]) -> DataFrame:
    return events.withColumn("beta", F.explode(F.array(*[F.lit(float(b)) for b in betas])))


def hawkes_loglik(history: DataFrame, series: Sequence[str], mu: Column, alpha: Column, end_ms: int, exposure_s: Column) -> DataFrame:
    """Log-likelihood of each series at given parameters; ``history`` comes from :func:`decayed_history`."""
    b = F.col("beta")
    rate = mu + alpha * b * F.col("history")
    left = 1 - F.exp(-b * (end_ms - F.col("t_ms")) / 1000.0)
    return history.groupBy(*series).agg(F.count(F.lit(1)).alias("n"), F.sum(F.log(rate)).alias("_logs"), F.sum(left).alias("_mass"),
                                        F.max(mu).alias("mu"), F.max(alpha).alias("alpha"), exposure_s.alias("_t")).withColumn(
        "loglik", F.col("_logs") - F.col("mu") * F.col("_t") - F.col("alpha") * F.col("_mass")).drop("_logs", "_mass", "_t")


def model_choice(delta_aic: Column) -> Column:
    return F.when(delta_aic > 10, "strong_self_excitation").when(delta_aic > 2, "moderate_self_excitation").otherwise("weak_or_none")


def excitation_label(alpha: Column) -> Column:
    return F.when(alpha > 0.5, "strong").when(alpha > 0.2, "moderate").otherwise("weak")


LOW_ALPHA, HIGH_ALPHA = 1e-6, 0.999


def _newton(h: DataFrame, series: str, params: dict[tuple, tuple], exposure: float, steps: int) -> dict[tuple, tuple]:
    """(log-likelihood, mu, alpha, n, settled) per (series, decay), by damped Newton steps from ``params``.

    ``h`` has ``series, beta, r, m``.  A round is one aggregate over all pairs; pairs that are settled leave it.
    """
    spark = h.sparkSession
    kind = h.schema[series].dataType.simpleString()
    rate = F.col("mu") + F.col("alpha") * F.col("r")
    kept: dict[tuple, tuple] = {}
    move: dict[tuple, tuple] = {}
    open_params = dict(params)
    for _ in range(steps):
        table = literal_rows(spark, [(*key, *value) for key, value in open_params.items()], f"{series} {kind}, beta double, mu double, alpha double")
        sums = h.join(F.broadcast(table), [series, "beta"]).groupBy(series, "beta").agg(
            F.count(F.lit(1)).alias("n"), F.sum("m").alias("mass"), F.sum(F.log(rate)).alias("l"), F.sum(1 / rate).alias("g0"), F.sum(F.col("r") / rate).alias("g1"),
            F.sum(1 / (rate * rate)).alias("h00"), F.sum(F.col("r") / (rate * rate)).alias("h01"), F.sum(F.col("r") * F.col("r") / (rate * rate)).alias("h11")).collect()
        following: dict[tuple, tuple] = {}
        for row in sums:
            key = (row[series], row["beta"])
            mu, alpha = open_params[key]
            value = row["l"] - mu * exposure - alpha * row["mass"]
            if key in kept and value < kept[key][0]:
                move[key] = (move[key][0] / 2, move[key][1] / 2)
            else:
                kept[key] = (value, mu, alpha, row["n"], False)
                g0, g1 = row["g0"] - exposure, row["g1"] - row["mass"]
                det = row["h00"] * row["h11"] - row["h01"] ** 2
                pinned = (alpha <= LOW_ALPHA and g1 <= 0) or (alpha >= HIGH_ALPHA and g1 >= 0)
                if not pinned and det > 1e-12 * row["h00"] * max(row["h11"], 1e-300):
                    move[key] = ((row["h11"] * g0 - row["h01"] * g1) / det, (row["h00"] * g1 - row["h01"] * g0) / det)
                else:
                    move[key] = (g0 / row["h00"], 0.0)
            _, mu, alpha, n, _ = kept[key]
            step = (min(max(mu + move[key][0], 0.2 * mu), 5 * mu), min(max(alpha + move[key][1], LOW_ALPHA), HIGH_ALPHA))
            if abs(step[0] - mu) <= 1e-6 * mu and abs(step[1] - alpha) <= 1e-6:
                kept[key] = (*kept[key][:4], True)
            else:
                following[key] = step
        open_params = following
        if not open_params:
            break
    return kept


def _next_decays(tried: set[float], best: float, spacing: float, limits: tuple[float, float]) -> tuple[list[float], float]:
    """Decays to try beside the best one and the spacing they leave: outwards from an edge, else a third as far apart."""
    if best == min(tried) and best > limits[0]:
        return sorted({max(best / f, limits[0]) for f in (3.0, 9.0)}), spacing
    if best == max(tried) and best < limits[1]:
        return sorted({min(best * f, limits[1]) for f in (3.0, 9.0)}), spacing
    return [best * math.exp(k * spacing / 3) for k in (-2, -1, 1, 2) if limits[0] <= best * math.exp(k * spacing / 3) <= limits[1]], spacing / 3


def fit_hawkes(events: DataFrame, series: str, session: str, *, end_ms: int, betas: Sequence[float] = (0.02, 0.05, 0.1, 0.3, 1.0, 3.0, 10.0),
               steps: int = 60, refinements: int = 12, gain: float = 1e-3, limits: tuple[float, float] = (1e-4, 1e4)) -> DataFrame:
    """Maximum-likelihood ``mu, alpha, beta`` per series, pooled over sessions.

    For a fixed decay the log-likelihood is concave in ``(mu, alpha)``, so each round is one aggregate of its gradient and
    curvature over all series and decays at once, followed by a damped Newton step on the driver (a handful of numbers).
    The decay grid is then extended while the best value lies at its edge, and refined around it until a round gains less
    than ``gain``.  ``converged`` tells whether both the Newton steps and the decay of a series came to rest inside
    ``limits`` within ``steps`` and ``refinements``.  The likelihood may have several maxima along the decay; the one found
    is that beside the best value of ``betas``, so the grid should be wide.
    """
    spark = events.sparkSession
    sessions = events.select(session).distinct().count()
    exposure = sessions * end_ms / 1000.0
    kind = events.schema[series].dataType.simpleString()
    grid = events.select(session, series, "t_ms", "event_id")
    small = not time_order(grid, (session, series)).split  # counted once for all decays
    lie = (lambda rows: rows.repartition(session, series)) if small else (lambda rows: rows)  # shuffled before decays multiply the rows
    best: dict[str, tuple] = {}
    tried: dict[str, set[float]] = {}
    spacing: dict[str, float] = {}
    at_rest: set[str] = set()
    wanted: dict[str, list[float]] | None = None
    first_spacing = max((math.log(b / a) for a, b in zip(sorted(betas), sorted(betas)[1:])), default=math.log(3.0))
    for attempt in range(refinements + 1):
        if wanted is None:
            points = with_decay_rates(lie(grid), betas)
        else:
            near = literal_rows(spark, [(name, b) for name, some in wanted.items() for b in some], f"{series} {kind}, beta double")
            points = lie(grid.filter(F.col(series).isin(*wanted))).join(F.broadcast(near), series)
        h = cut_lineage(decayed_history(points, [session, series], "beta", small=small or None).select(
            series, "beta", (F.col("beta") * F.col("history")).alias("r"), (1 - F.exp(-F.col("beta") * (end_ms - F.col("t_ms")) / 1000.0)).alias("m")))
        sizes = {(row[series], row["beta"]): row["n"] for row in h.groupBy(series, "beta").agg(F.count(F.lit(1)).alias("n")).collect() if row[series] is not None}
        start = {key: (best[key[0]][0], min(max(best[key[0]][1], 0.01), 0.9)) if key[0] in best else (0.5 * n / exposure, 0.3) for key, n in sizes.items()}
        before = {name: row[3] for name, row in best.items()}
        for (name, beta), (value, mu, alpha, n, settled) in _newton(h, series, start, exposure, steps).items():
            tried.setdefault(name, set()).add(beta)
            if name not in best or value > best[name][3]:
                best[name] = (mu, alpha, beta, value, n, settled)
        wanted = {}
        for name, row in best.items():
            if name in at_rest:
                continue
            inside = min(tried[name]) < row[2] < max(tried[name])
            if name in before and inside and row[3] - before[name] < gain:
                at_rest.add(name)
                continue
            some, spacing[name] = _next_decays(tried[name], row[2], spacing.get(name, first_spacing), limits)
            if some:
                wanted[name] = some
        if not wanted:
            break
    rows = [(name, mu, alpha, beta, value, n, 6 - 2 * value, 3 * math.log(n) - 2 * value, settled and name in at_rest) for name, (mu, alpha, beta, value, n, settled) in best.items()]
    fitted = spark.createDataFrame(rows, f"{series} {kind}, mu double, alpha double, beta double, loglik double, n long, aic double, bic double, converged boolean")
    return fitted.withColumn("excitation", excitation_label(F.col("alpha")))


def fit_multivariate(events: DataFrame, kind: str, session: str, kinds: Sequence[str], *, end_ms: int, beta: float = 1.0, steps: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """Cross-excitation of a fixed, small set of event types at a fixed decay, by expectation-maximisation.

    Only strictly earlier events excite: events are counted per instant and type, and the history runs over instants.
    Histories are computed once; a round is one aggregate per target type.  Rounds end when the log-likelihood gains less
    than ``tolerance`` of its size (``converged``) or after ``steps``.  ``loglik`` belongs to the published parameters.
    """
    spark = events.sparkSession
    exposure = events.select(session).distinct().count() * end_ms / 1000.0
    instants = events.filter(F.col(kind).isin(*kinds)).groupBy(session, "t_ms").agg(*[F.count_if(F.col(kind) == name).cast("double").alias(f"n{i}") for i, name in enumerate(kinds)])
    instants = instants.withColumns({"beta": F.lit(float(beta)), "event_id": F.lit(0).cast("long")})
    weights = {f"h{i}": F.col(f"n{i}") for i in range(len(kinds))}
    cells = F.explode(F.array(*[F.struct(F.lit(name).alias("target"), F.col(f"n{i}").alias("n")) for i, name in enumerate(kinds)])).alias("x")
    h = decayed_history(instants, [session], "beta", weights=weights)
    h = h.select(cells, *weights, (1 - F.exp(-beta * (end_ms - F.col("t_ms")) / 1000.0)).alias("m")).select("x.*", *weights, "m")
    h = cut_lineage(h.filter("n > 0"))
    base = {row["target"]: (row["events"], row["mass"]) for row in h.groupBy("target").agg(F.sum("n").alias("events"), F.sum(F.col("n") * F.col("m")).alias("mass")).collect()}
    d = len(kinds)
    mass = [base.get(name, (0.0, 0.0))[1] for name in kinds]
    mu = [0.5 * base.get(name, (0.0, 0.0))[0] / exposure for name in kinds]
    alpha = [[0.05 if base.get(name, (0.0, 0.0))[0] else 0.0] * d for name in kinds]
    part = lambda j: F.col(f"a{j}") * beta * F.col(f"h{j}")
    rate = sum((part(j) for j in range(d)), F.col("mu"))

    def measure() -> tuple[dict, float]:
        table = literal_rows(spark, [(name, mu[i], *alpha[i]) for i, name in enumerate(kinds)], "target string, mu double, " + ", ".join(f"a{j} double" for j in range(d)))
        sums = h.join(F.broadcast(table), "target").groupBy("target").agg(F.sum(F.col("n") * F.log(rate)).alias("l"), F.sum(F.col("n") * F.col("mu") / rate).alias("b"),
                                                                         *[F.sum(F.col("n") * part(j) / rate).alias(f"t{j}") for j in range(d)]).collect()
        found = {row["target"]: row for row in sums}
        return found, sum(found[name]["l"] - mu[i] * exposure - sum(a * m for a, m in zip(alpha[i], mass)) for i, name in enumerate(kinds) if name in found)

    found, value = measure()
    converged = False
    for _ in range(steps):
        for i, name in enumerate(kinds):
            if name in found:
                mu[i] = max(found[name]["b"] / exposure, 1e-12)
                alpha[i] = [min(found[name][f"t{j}"] / mass[j], HIGH_ALPHA) if mass[j] > 0 else 0.0 for j in range(d)]
        found, following = measure()
        converged = abs(following - value) <= tolerance * max(1.0, abs(value))
        value = following
        if converged:
            break
    rows = [(target, source, mu[i], alpha[i][j], value, converged) for i, target in enumerate(kinds) for j, source in enumerate(kinds)]
    out = spark.createDataFrame(rows, "target string, source string, mu double, alpha double, loglik double, converged boolean")
    own = F.col("target") == F.col("source")
    label = (F.when(own & (F.col("alpha") > 0.2), "strong").when(own & (F.col("alpha") > 0.05), "moderate").when(own, "weak")
             .when(F.col("alpha") > 0.01, "cross").otherwise("none"))
    return out.withColumn("excitation", label)
