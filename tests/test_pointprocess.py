"""Point-process sums and fits."""

import math
import random

from pyspark.sql import functions as F

from sessionlake.operators import pointprocess as ops


def events(spark, n=400, seed=2):
    rng = random.Random(seed)
    data, t = [], 0
    for i in range(n):
        t += rng.choice([5, 20, 40, 3_000, 9_000])
        data.append((1 + i % 2, t, i, rng.choice(["a", "b"])))
    return spark.createDataFrame(data, "session_id long, t_ms long, event_id long, event_type string"), data


def test_history_equals_direct_sum(spark):
    df, data = events(spark)
    for beta in (0.02, 1.0, 25.0):
        out = ops.decayed_history(df.withColumn("beta", F.lit(beta)), ["session_id"], "beta")
        got = {r["event_id"]: r["history"] for r in out.collect()}
        for s, t, i, _ in data:
            direct = sum(math.exp(-beta * (t - u) / 1000) for q, u, j, _ in data if q == s and (u, j) < (t, i))
            assert abs(got[i] - direct) < 1e-9


def test_fit_is_at_least_as_good_as_a_grid(spark):
    df, data = events(spark, 200)
    end = max(d[1] for d in data) + 1_000
    fit = {r["event_type"]: r for r in ops.fit_hawkes(df, "event_type", "session_id", end_ms=end, betas=(0.1, 1.0, 10.0), refinements=0).collect()}
    exposure = 2 * end / 1000
    for kind in ("a", "b"):
        mine = [d for d in data if d[3] == kind]

        def loglik(mu, alpha, beta):
            total = -mu * exposure
            for s, t, i, _ in mine:
                h = sum(math.exp(-beta * (t - u) / 1000) for q, u, j, _ in mine if q == s and (u, j) < (t, i))
                total += math.log(mu + alpha * beta * h) - alpha * (1 - math.exp(-beta * (end - t) / 1000))
            return total

        best = max(loglik(mu, alpha, beta) for mu in (0.05, 0.1, 0.15, 0.2) for alpha in (0.05, 0.2, 0.4, 0.6) for beta in (0.1, 1.0, 10.0))
        row = fit[kind]
        assert row["loglik"] >= best - 1e-6
        assert abs(row["loglik"] - loglik(row["mu"], row["alpha"], row["beta"])) < 1e-3


def test_multivariate_loglik_never_falls(spark):
    df, data = events(spark, 150)
    end = max(d[1] for d in data) + 1_000
    values = [ops.fit_multivariate(df, "event_type", "session_id", ["a", "b"], end_ms=end, steps=steps).first()["loglik"] for steps in (2, 5, 9)]
    assert values == sorted(values)


def test_only_strictly_earlier_events_excite_each_other(spark):
    data = [(1, 1_000, 1, "a"), (1, 1_000, 2, "b"), (1, 1_000, 3, "b"), (1, 2_500, 4, "a"), (1, 2_500, 5, "b"), (1, 2_900, 6, "a"), (1, 6_000, 7, "b")]
    df = spark.createDataFrame(data, "session_id long, t_ms long, event_id long, event_type string")
    end = 8_000
    for steps in (1, 4, 100):
        rows = ops.fit_multivariate(df, "event_type", "session_id", ["a", "b"], end_ms=end, steps=steps).collect()
        mu = {r["target"]: r["mu"] for r in rows}
        alpha = {(r["target"], r["source"]): r["alpha"] for r in rows}
        total = -sum(mu.values()) * end / 1000
        for _, t, _, kind in data:
            total += math.log(mu[kind] + sum(alpha[kind, other] * math.exp(-(t - u) / 1000) for _, u, _, other in data if u < t))
            total -= sum(alpha[target, kind] * (1 - math.exp(-(end - t) / 1000)) for target in mu)
        assert abs(rows[0]["loglik"] - total) < 1e-9
    assert rows[0]["converged"]


def test_decay_is_found_between_and_beyond_the_grid(spark):
    df, _ = events(spark, 300)
    df = df.withColumn("event_type", F.lit("a"))
    end = df.agg(F.max("t_ms")).first()[0] + 1_000
    near = ops.fit_hawkes(df, "event_type", "session_id", end_ms=end, betas=(10.0, 30.0, 100.0)).first()
    far = ops.fit_hawkes(df, "event_type", "session_id", end_ms=end, betas=(4.0, 6.0)).first()
    assert near["converged"] and far["converged"] and far["beta"] > 6.0
    assert abs(near["loglik"] - far["loglik"]) < 0.01


def test_history_shuffles_rows_once(spark):
    """Series that fit a window need neither a count of tiles nor joins of what tiles leave; the result is that of cut series."""
    rng = random.Random(4)
    rows = [(s, t, i) for s in (1, 2) for i, t in enumerate(sorted(rng.choice([rng.randrange(2_000), rng.randrange(400_000)]) for _ in range(150)))]
    df = ops.with_decay_rates(spark.createDataFrame(rows, "session_id long, t_ms long, event_id long").repartition("session_id"), [0.3, 2.0, 20.0])
    out = ops.decayed_history(df, ["session_id"], "beta", small=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    for r in out.collect():
        direct = sum(math.exp(-r.beta * (r.t_ms - t) / 1000) for s, t, i in rows if s == r.session_id and (t, i) < (r.t_ms, r.event_id))
        assert abs(r.history - direct) < 1e-9
