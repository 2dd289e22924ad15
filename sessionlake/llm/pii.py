"""Personal data in whole texts: high-recall generators, boosted trees over format and context, calibrated thresholds.

Generators propose spans that may overlap: the base kinds (email, ip, card, phone) with their own checks, and looser ones (number
groups without a plus, account numbers, national number groups). Spans that pass a base kind's check always stay. Every
candidate has a few small whole-number features of its format (length, digits, separators, variety) and its context (what
stands before, whether a telling word is near).

The training rows are candidates whose format can be proven right or wrong: check digit, octet range, number of digits. All
of them are counted by feature cell in one aggregation; the number of cells is bounded by the grid of features, not by the data.
Trees of depth two are boosted on these cells (logistic loss, Newton leaves), and the whole model is one SQL expression.
Scores become probabilities by bins of equal weight on the cells, pooled until they rise; the threshold is the lowest bin
whose precision, and that of all above, reaches TARGET_PRECISION. Loose candidates at or above it are added when they overlap
no base span, have a telling word beside them, and exceed the learned threshold.

Defined cases: null is an empty text; without candidates of both outcomes nothing is learned and only base spans are returned;
repeated rows are reported each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.spans import count_kind, located, overlaps, written
from sessionlake.session import cut_lineage

KINDS = ["email", "ip", "card", "phone", "local_phone", "account", "national_number"]
BASE = 4

# fixed values: formats of the base kinds. Runs are possessive and anchored at their first character (or the end of the last
# match), which finds the same matches without trying a run again from each of its characters.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOOSE = {
    4: r"(?<![A-Za-z0-9+.-])\(?[0-9]{2,5}\)?(?:[\x20.-][0-9]{2,5}){2,4}(?![A-Za-z0-9])",
    5: r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    6: r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}"
TELLING = r"(?i)(phone|tel|call|fax|mobile|mail|contact|iban|account|ssn|social|passport|card|visa|host|server|\bip\b)[^A-Za-z]*$"
FEATURES = ("digits", "length", "separators", "variety", "before", "telling")
TARGET_PRECISION = 0.99
TREES, RATE, LIMIT_CELLS = 24, 0.3, 100_000


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check: from the right, every second digit doubled and its digits summed."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    spread = F.transform(values, lambda v, i: F.when(i % 2 == 1, F.when(v > 4, v * 2 - 9).otherwise(v * 2)).otherwise(v))
    return F.aggregate(spread, F.lit(0), lambda s, v: s + v) % 10 == 0


def _candidate(kind: int):
    return lambda s: _described(kind, s)


def _described(kind: int, s: Column) -> Column:
    match, before = s["match"], s["before"]
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    proven = {0: F.lit(True), 1: match.rlike(OCTETS), 2: n.between(12, 19) & F.when(n <= 19, luhn(digits)).otherwise(F.lit(False)), 3: n.between(9, 15)}.get(kind, F.lit(None).cast("boolean"))
    context = F.right(before, F.lit(24))
    return F.struct(
        s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), proven.alias("proven"),
        F.least(n, F.lit(20)).alias("digits"), F.least(F.floor(F.length(match) / 4), F.lit(8)).cast("int").alias("length"),
        F.least(F.length(F.regexp_replace(match, "[A-Za-z0-9]", "")), F.lit(6)).alias("separators"),
        F.least(F.size(F.array_distinct(F.split(F.substring(match, 1, 40), ""))), F.lit(12)).alias("variety"),
        F.when(context == "", 0).when(context.rlike(r"[\x20\n\t]$"), 1).when(context.rlike("[A-Za-z0-9]$"), 2).otherwise(3).alias("before"),
        context.rlike(TELLING).cast("int").alias("telling"))


def candidates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id and all proposed spans (array of structs) of every row."""
    rows = docs.select(docs[f"`{id_column}`"].alias(id_column), F.coalesce(docs[f"`{text}`"], F.lit("")).alias("body"))
    patterns = {0: EMAIL, 1: IP, 2: CARD, 3: PHONE, **LOOSE}
    guards = {0: F.col("body").contains("@"), 3: F.col("body").contains("+")}
    found = rows.select(id_column, *(F.when(guards.get(k, F.lit(True)), located(F.col("body"), p)).alias(f"k{k}") for k, p in patterns.items()))
    # Most runs of digits are no card; keep those with a plausible number of digits as counterexamples.
    spans = []
    for k in patterns:
        kind = F.coalesce(F.col(f"k{k}"), F.array().cast("array<struct<start:int,end:int,match:string,before:string>>"))
        if k == 2:
            kind = F.filter(kind, lambda s: F.length(s["match"]) >= 12)
        spans.append(F.transform(kind, _candidate(k)))
    return found.select(id_column, F.concat(*spans).alias("spans"))


class Model:
    """Boosted trees (feature, cut, feature, cut, four leaves), a base score and a threshold on the score."""

    def __init__(self, base: float, trees: list, threshold: float):
        self.base, self.trees, self.threshold = base, trees, threshold

    def score(self, row: dict) -> float:
        return self.base + sum(leaves[2 * (row[f] > a) + (row[g] > b)] for f, a, g, b, leaves in self.trees)

    def expression(self, span: Column) -> Column:
        total = F.lit(self.base)
        for f, a, g, b, leaves in self.trees:
            low = F.when(span[g] > b, leaves[1]).otherwise(leaves[0])
            high = F.when(span[g] > b, leaves[3]).otherwise(leaves[2])
            total = total + F.when(span[f] > a, high).otherwise(low)
        return total


def boost(cells: list[dict], trees: int = TREES, rate: float = RATE, precision: float = TARGET_PRECISION) -> Model | None:
    """Fit on cells: the features, `good` and `bad` counts."""
    good, bad = sum(c["good"] for c in cells), sum(c["bad"] for c in cells)
    if not good or not bad:
        return None
    base = math.log(good / bad)
    model = Model(base, [], 0.0)
    scores = [base] * len(cells)
    cuts = {f: sorted({c[f] for c in cells})[:-1] for f in FEATURES}
    splits = [(f, a) for f in FEATURES for a in cuts[f]]

    def gains(grad: list, hess: list, rows: range | list) -> tuple:
        best = (-1.0, FEATURES[0], 0)
        g_all, h_all = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
        for f, a in splits:
            g = h = 0.0
            for i in rows:
                if cells[i][f] > a:
                    g, h = g + grad[i], h + hess[i]
            gain = g * g / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1)
            best = max(best, (gain, f, a))
        return best

    for _ in range(trees):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        grad = [c["good"] - (c["good"] + c["bad"]) * q for c, q in zip(cells, p)]
        hess = [(c["good"] + c["bad"]) * q * (1 - q) for c, q in zip(cells, p)]
        _, f, a = gains(grad, hess, range(len(cells)))
        sides = [[i for i in range(len(cells)) if (cells[i][f] > a) == up] for up in (False, True)]
        _, g, b = max(gains(grad, hess, side) for side in sides)
        leaves = [0.0] * 4
        for leaf in range(4):
            rows = [i for i in range(len(cells)) if 2 * (cells[i][f] > a) + (cells[i][g] > b) == leaf]
            leaves[leaf] = rate * sum(grad[i] for i in rows) / (sum(hess[i] for i in rows) + 1)
        model.trees.append((f, a, g, b, leaves))
        scores = [s + leaves[2 * (c[f] > a) + (c[g] > b)] for s, c in zip(scores, cells)]
    # Calibration: pool neighbouring scores until the share of good ones rises, then find where it is high enough.
    pooled: list[list[float]] = []
    for s, c in sorted(zip(scores, cells), key=lambda x: x[0]):
        pooled.append([s, c["good"], c["good"] + c["bad"]])
        while len(pooled) > 1 and pooled[-2][1] * pooled[-1][2] >= pooled[-1][1] * pooled[-2][2]:
            low, high = pooled[-2], pooled.pop()
            low[1], low[2] = low[1] + high[1], low[2] + high[2]
    sure = [s for s, g, n in pooled if g >= precision * n]
    model.threshold = min(sure) if sure else math.inf
    return model


def fit(proposed: DataFrame) -> Model | None:
    span = proposed.select(F.explode("spans").alias("s")).filter("s.proven is not null").select("s.*")
    counts = span.groupBy(*FEATURES).agg(F.count_if("proven").alias("good"), F.count_if(~F.col("proven")).alias("bad"))
    cells = [row.asDict() for row in counts.orderBy(*FEATURES).limit(LIMIT_CELLS + 1).collect()]
    if len(cells) > LIMIT_CELLS:
        raise ValueError("more feature cells than the feature grid has")
    return boost(cells)


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, base and all (array<struct<start, kind, end>>) of every row."""
    proposed = cut_lineage(candidates(docs, id_column, text))
    model = fit(proposed)
    slim = lambda spans: F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))
    rows = proposed.select(id_column, "spans", F.array_sort(slim(F.filter("spans", lambda s: F.coalesce(s["proven"], F.lit(False))))).alias("base"))
    if model is None or math.isinf(model.threshold):
        extra = F.filter("base", lambda s: F.lit(False))
    else:
        extra = slim(F.filter("spans", lambda s: (s["kind"] >= BASE) & (s["telling"] == 1) & ~overlaps(F.col("base"), s["start"], s["end"]) & (model.expression(s) >= model.threshold)))
    return rows.select(id_column, "base", F.array_sort(F.concat("base", extra)).alias("all"))


def redact(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with every found span replaced by its kind in brackets; overlapping spans are one, named by the first."""
    spans = found.select(id_column, "all").groupBy(id_column).agg(F.first("all").alias("_spans"))
    rows = docs.join(spans, id_column, "left")
    names = F.array(*(F.lit(f"[{k}]") for k in KINDS))

    def add(state: Column, s: Column) -> Column:
        gap = F.substring(F.col(f"`{text}`"), state["at"] + 1, s["start"] - state["at"])
        fresh = s["start"] >= state["at"]
        return F.struct(F.when(fresh, F.concat(state["out"], gap, F.get(names, s["kind"]))).otherwise(state["out"]).alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    body = F.aggregate(F.coalesce("_spans", F.array().cast("array<struct<start:int,kind:int,end:int>>")), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), add,
                       lambda s: F.concat(s["out"], F.substring(F.col(f"`{text}`"), s["at"] + 1, F.length(F.col(f"`{text}`")))))
    return rows.withColumn(text, body).drop("_spans").select(*docs.columns)


def personal_digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *(count_kind(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(BASE)),
                        F.sha2(written(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"), written(F.col("all"), KINDS).alias("spans"))
