"""Nearest-neighbour votes and forests over pickup features."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.scalars import first_max_name
from sessionlake.operators.ordering import running_sum, time_order
from sessionlake.session import cut_lineage


def scaled_by(reference: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Standardised columns, with the mean and population deviation of the reference rows."""
    row = reference.agg(*[f for c in columns for f in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    return {c: (F.col(c) - F.lit(row[f"m_{c}"])) / F.lit(row[f"s_{c}"] or 1.0) for c in columns}


def nearest_points(places: DataFrame, points: DataFrame, fields: Sequence[str], weight: str, k: int, *, levels: int | None = None) -> DataFrame:
    """fields and `z`, the ``k`` nearest rows of ``points`` by distance, then by place (array of `d`, `at_<field>`, and what else a point has), for every distinct place.

    Grids of halving cell width lie over the points; every cell knows its rows and the box of its points. The cells around a place, taken by the farthest
    corner of their box until they hold ``k`` rows, bound the distance of its k-th row, at each level; the place takes the least bound and meets the points
    of all cells within it, at the level whose width fits it. So the result is exact, and no place is asked twice. ``weight`` counts the rows of a point.
    """
    fields = list(fields)
    count, *box = points.agg(F.count(F.lit(1)), *[f(c) for c in fields for f in (F.min, F.max)]).first()
    low, high = box[0::2], box[1::2]
    extent = max(*(hi - lo for lo, hi in zip(low, high)), 1e-9) * 1.000001
    levels = levels if levels is not None else min(24, max(0, math.ceil(math.log2(max(1.0, count / k)) / len(fields)) + 2))
    width, last = F.lit(extent) / F.pow(F.lit(2.0), F.col("level")), F.pow(F.lit(2.0), F.col("level")).cast("long") - 1
    cells = [f"_c{i}" for i in range(len(fields))]
    index = lambda at, lo: F.greatest(F.lit(0).cast("long"), F.least(last, F.floor((at - F.lit(lo)) / width).cast("long")))
    tile = lambda df: df.withColumns({name: index(F.col(c), lo) for name, c, lo in zip(cells, fields, low)})
    ladder = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    tiled = cut_lineage(tile(points.select("*", ladder)))
    edges = [f(c).alias(f"_{side}{i}") for i, c in enumerate(fields) for f, side in ((F.min, "lo"), (F.max, "hi"))]
    boxes = cut_lineage(tiled.groupBy("level", *cells).agg(F.sum(weight).alias("_rows"), *edges))
    length = lambda sides: F.sqrt(sum((x * x for x in sides[1:]), sides[0] * sides[0]))
    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # places are few bytes but much work, so their number of tasks is given
    asked = places.select(*fields).distinct().repartition(parts, *fields)
    around = tile(asked.select("*", ladder))
    for i in cells:
        around = around.withColumn(i, F.explode(F.array(F.col(i) - 1, F.col(i), F.col(i) + 1)))
    corner = length([F.greatest(F.abs(F.col(c) - F.col(f"_lo{i}")), F.abs(F.col(c) - F.col(f"_hi{i}"))) for i, c in enumerate(fields)])
    upto = Window.partitionBy(*fields, "level").orderBy("_far").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounds = around.join(boxes, ["level", *cells]).withColumn("_far", corner).withColumn("_sum", F.sum("_rows").over(upto))
    bounds = bounds.groupBy(*fields).agg((F.min(F.when(F.col("_sum") >= k, F.col("_far"))) * 1.000001).alias("reach"))  # null where all points together have fewer rows
    fit = F.floor(F.log2(F.lit(2 * extent) / F.greatest(F.col("reach"), F.lit(extent / 2.0 ** levels)))).cast("int")
    own = cut_lineage(bounds.withColumn("level", F.when(F.col("reach").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(levels), fit)))))
    for i, c, lo in zip(cells, fields, low):
        ends = [F.when(F.col("level") == 0, 0).otherwise(index(F.col(c) + side * F.col("reach"), lo)).cast("long") for side in (-1, 1)]
        own = own.withColumn(i, F.explode(F.sequence(*ends)))
    border = length([F.greatest(F.lit(0.0), F.col(f"_lo{i}") - F.col(c), F.col(c) - F.col(f"_hi{i}")) for i, c in enumerate(fields)])
    within = lambda d: F.coalesce(d <= F.col("reach"), F.lit(True))
    met = tiled.withColumnsRenamed({c: f"at_{c}" for c in fields})
    item = F.struct("d", *[c for c in met.columns if c not in ("level", *cells)])
    kept = own.join(boxes, ["level", *cells]).filter(within(border)).select(*fields, "reach", "level", *cells)
    near = kept.join(met, ["level", *cells]).withColumn("d", length([F.col(c) - F.col(f"at_{c}") for c in fields])).filter(within(F.col("d")))
    nearest_first = Window.partitionBy(*fields).orderBy("d", *[f"at_{c}" for c in fields])
    best = near.withColumn("_no", F.row_number().over(nearest_first)).filter(F.col("_no") <= k)
    return best.groupBy(*fields).agg(F.array_sort(F.collect_list(item)).alias("z"))


def nearest_votes(queries: DataFrame, reference: DataFrame, columns: Sequence[str], label: str, labels: Sequence[str], *, ident: str = "event_id", k: int = 31) -> DataFrame:
    """Distance-weighted vote of the ``k`` nearest reference rows.

    The reference is first reduced to distinct points with a count per class, the queries to distinct places, which search on grids (``nearest_points``).
    A query at distance zero to some neighbours is decided by those alone.
    """
    scale = scaled_by(reference, columns)
    fields = [f"_f{i}" for i in range(len(columns))]
    place = [scale[c].alias(name) for c, name in zip(columns, fields)]
    known = " AND ".join(f"{name} IS NOT NULL" for name in fields)
    counts = reference.select(*place, F.col(label)).filter(known).groupBy(*fields).agg(*[F.count_if(F.col(label) == name).alias(f"_n{i}") for i, name in enumerate(labels)])
    points = counts.select(*fields, F.array(*[F.col(f"_n{i}") for i in range(len(labels))]).alias("n"), sum((F.col(f"_n{i}") for i in range(1, len(labels))), F.col("_n0")).alias("rows"))
    asked = queries.select(ident, *place).filter(known)
    if points.isEmpty():
        return asked.limit(0).select(ident, *[F.lit(None).cast("double").alias(f"p_{name}") for name in labels])
    merged = asked.join(nearest_points(asked, points, fields, "rows", k), fields).select(ident, "z")
    ordered = F.col("z")
    first = F.struct(F.lit(0).cast("long").alias("used"), *[F.lit(0.0).alias(f"w{i}") for i in range(len(labels))], *[F.lit(0.0).alias(f"e{i}") for i in range(len(labels))])

    def add(acc: Column, x: Column) -> Column:
        room, out_w, out_e = F.lit(k) - acc["used"], [], []
        for i in range(len(labels)):
            take = F.greatest(F.lit(0), F.least(x["n"][i], room)).cast("long")
            out_w.append((acc[f"w{i}"] + F.when(x["d"] > 0, take / x["d"]).otherwise(0.0)).alias(f"w{i}"))
            out_e.append((acc[f"e{i}"] + F.when(x["d"] == 0, take.cast("double")).otherwise(0.0)).alias(f"e{i}"))
            room = room - take
        return F.struct((F.lit(k) - room).cast("long").alias("used"), *out_w, *out_e)

    d = merged.select(ident, F.aggregate(ordered, first, add).alias("v"))
    exact = sum((F.col(f"v.e{i}") for i in range(1, len(labels))), F.col("v.e0"))
    votes = [F.when(exact > 0, F.col(f"v.e{i}")).otherwise(F.col(f"v.w{i}")) for i in range(len(labels))]
    whole = sum(votes[1:], votes[0])
    return d.select(ident, *[(vote / whole).alias(f"p_{name}") for vote, name in zip(votes, labels)])


def stratified_folds(rows: DataFrame, label: str, ident: str, folds: int = 3) -> DataFrame:
    """Fold number per row; every class is dealt out evenly in hash order."""
    d = rows.withColumn("_h", F.shiftrightunsigned(F.xxhash64(F.col(ident)), 2))
    order = time_order(d, label, ("_h", ident))
    d = order.untag(order.running(order.tag(d), _n=running_sum(F.lit(1).cast("long"))))
    return d.withColumn("fold", (F.col("_n") % folds).cast("int")).drop("_h", "_n")


def _stages(features: Sequence[str], label: str, trees: int, depth: int, seed: int):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler

    filled = [f"{name}_filled" for name in features]
    return [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_x"),
        StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc"),
        RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=3, featureSubsetStrategy="sqrt", seed=seed)]


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """Row weights that give every class the same total."""
    sizes = {row[label]: row["n"] for row in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, classes = sum(sizes.values()), len(sizes)
    weight = F.lit(1.0)
    for name, n in sizes.items():
        weight = F.when(F.col(label) == name, F.lit(total / (classes * n))).otherwise(weight)
    return rows.withColumn("_weight", weight)


def fit_forest(rows: DataFrame, features: Sequence[str], label: str, *, trees: int = 500, depth: int = 9, seed: int = 20260802):
    from pyspark.ml import Pipeline

    # training reads its rows many times and costs far more than they weigh: they are written once, spread over all cores (more parts would each send the statistics of all nodes)
    spread = cut_lineage(rows.select(*features, label).repartition(rows.sparkSession.sparkContext.defaultParallelism))
    return Pipeline(stages=_stages(features, label, trees, depth, seed)).fit(balanced(spread, label))


def forest_predictions(model, rows: DataFrame, ident: str) -> DataFrame:
    """Predicted class and its probability."""
    from pyspark.ml.functions import vector_to_array

    names = list(model.stages[2].labels)
    scored = model.stages[3].transform(model.stages[1].transform(model.stages[0].transform(rows)))
    p = vector_to_array("probability")
    index = (F.col("prediction") + 1).cast("int")
    return scored.select(ident, F.element_at(F.array(*[F.lit(n) for n in names]), index).alias("prediction"), F.element_at(p, index).alias("confidence"))


def forest_probabilities(model, rows: DataFrame, ident: str, labels: Sequence[str]) -> DataFrame:
    """`p_<label>` for every label; a label the forest was not trained on has probability zero."""
    from pyspark.ml.functions import vector_to_array

    names = list(model.stages[2].labels)
    scored = model.stages[3].transform(model.stages[1].transform(model.stages[0].transform(rows)))
    p = vector_to_array("probability")
    return scored.select(ident, *[(F.element_at(p, names.index(name) + 1) if name in names else F.lit(0.0)).alias(f"p_{name}") for name in labels])


def combined_prediction(rows: DataFrame, labels: Sequence[str], *, rare_label: str, rare: Column, saturated: Column, override: Column,
                        seen_label: Column, score: Column, ceiling: float = 0.99) -> DataFrame:
    """One decision per row from the probabilities `p_<label>` of a model and from evidence that outranks it; replaces them, adds `prediction, reason`.

    In order: one strong visual track decides a row whose value is saturated (its score, the rest shared by the other labels); any other saturated row stays
    open (empty prediction, probabilities zero); the guarded rare class decides with 0.65 to 0.99 by its score; else the model's largest probability, the
    first label on a tie. Null evidence is no evidence; without it a row with null probabilities stays open as `no_model`.
    """
    holds = lambda condition: F.coalesce(condition, F.lit(False))
    sure = F.least(F.lit(ceiling), F.greatest(F.lit(0.0), F.coalesce(score, F.lit(0.0))))
    rarely = F.least(F.lit(ceiling), F.greatest(F.lit(0.0), 0.65 + 0.35 * F.coalesce(score, F.lit(0.0))))
    known = F.lit(True)
    for name in labels:
        known = known & F.col(f"p_{name}").isNotNull()
    reason = (F.when(holds(override) & seen_label.isin(*labels), "single_strong_track").when(holds(saturated), "saturated_unresolved")
              .when(holds(rare), "guarded_rare_class").when(known, "model_probability").otherwise("no_model"))
    d = rows.withColumn("reason", reason)
    why = lambda name: F.col("reason") == name
    p = {name: (F.when(why("single_strong_track"), F.when(seen_label == name, sure).otherwise((1.0 - sure) / (len(labels) - 1)))
                .when(why("guarded_rare_class"), rarely if name == rare_label else F.lit(0.0)).when(why("model_probability"), F.col(f"p_{name}")).otherwise(0.0)) for name in labels}
    prediction = (F.when(why("single_strong_track"), seen_label).when(why("guarded_rare_class"), rare_label)
                  .when(why("model_probability"), first_max_name(labels, [F.col(f"p_{name}") for name in labels])).otherwise(""))
    return d.withColumns({"prediction": prediction, **{f"p_{name}": p[name] for name in labels}})


def out_of_fold(rows: DataFrame, features: Sequence[str], label: str, ident: str, *, folds: int = 3, trees: int = 500, depth: int = 9) -> DataFrame:
    """Every row predicted by a forest that has not seen its fold."""
    dealt = stratified_folds(rows, label, ident, folds)
    parts = []
    for fold in range(folds):
        model = fit_forest(dealt.filter(F.col("fold") != fold), features, label, trees=trees, depth=depth)
        test = dealt.filter(F.col("fold") == fold)
        parts.append(forest_predictions(model, test, ident).join(test.select(ident, label, "fold"), ident))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def importances(model, features: Sequence[str], spark) -> DataFrame:
    values = model.stages[3].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, values)), "feature string, importance double")
