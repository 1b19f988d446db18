"""Models with several outputs, fitted together: one model for each output (a feature to forecast, a step of it, or both).

Samples are long: one row for each sample and output, with the output's key columns, the inputs and y. Statistics
of all outputs come from one aggregate, so no model is fitted in a loop of its own; an output with a third of all
rows is combined before it is shuffled. Rows with a null y, or (linear) a null or non-finite input, don't count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import finite
from tidemark.operators.quantiles import quantiles
from tidemark.plans.lineage import dropped, stored

#: Of an input's variance so little may be left by the inputs before it; below that it counts as a combination of them.
DEPENDENT = 1e-10


def _dot(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a + b, [x * y for x, y in pairs], F.lit(0.0))


class LinearOutputs:
    """Least squares with an intercept for each output: covariances in one aggregate, every system solved in its row.

    An input that is constant, or a linear combination of those before it, gets the weight 0. An output without
    usable rows has no model, and its predictions are null.
    """

    def __init__(self, by: list[str]):
        self.by = list(by)

    def fit(self, samples: DataFrame, features: list[str]) -> LinearOutputs:
        self.features, n = list(features), len(features)
        x = [f"_x{i}" for i in range(n)]
        rows = samples.select(*self.by, *[finite(F.col(f).cast("double")).alias(c) for f, c in zip(features, x, strict=True)], finite(F.col("y").cast("double")).alias("_y")).dropna(subset=[*x, "_y"])
        moments = [F.covar_pop(x[i], x[j]).alias(f"_s{i}_{j}") for i in range(n) for j in range(i + 1)] + [F.covar_pop(c, "_y").alias(f"_z{i}") for i, c in enumerate(x)]
        solved = rows.groupBy(*self.by).agg(F.count("*").alias("n"), F.avg("_y").alias("_my"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(x)], *moments)
        c = F.col
        for j in range(n):  # S = L D L', a column of L at a time
            left = c(f"_s{j}_{j}") - _dot([(c(f"_l{j}_{k}") * c(f"_l{j}_{k}"), c(f"_d{k}")) for k in range(j)])
            solved = solved.withColumn(f"_d{j}", F.when(left > DEPENDENT * c(f"_s{j}_{j}"), left).otherwise(0.0))
            lower = {f"_l{i}_{j}": F.when(c(f"_d{j}") > 0, (c(f"_s{i}_{j}") - _dot([(c(f"_l{i}_{k}") * c(f"_l{j}_{k}"), c(f"_d{k}")) for k in range(j)])) / c(f"_d{j}")).otherwise(0.0) for i in range(j + 1, n)}
            solved = solved.withColumns({**lower, f"_z{j}": c(f"_z{j}") - _dot([(c(f"_l{j}_{k}"), c(f"_z{k}")) for k in range(j)])})
        for j in reversed(range(n)):
            own = F.when(c(f"_d{j}") > 0, c(f"_z{j}") / c(f"_d{j}")).otherwise(0.0)
            solved = solved.withColumn(f"_w{j}", F.when(c(f"_d{j}") > 0, own - _dot([(c(f"_l{i}_{j}"), c(f"_w{i}")) for i in range(j + 1, n)])).otherwise(0.0))
        weights = F.array(*[c(f"_w{i}") for i in range(n)]).cast("array<double>")
        self.model = solved.select(*self.by, "n", (c("_my") - _dot([(c(f"_w{i}"), c(f"_m{i}")) for i in range(n)])).alias("intercept"), weights.alias("weights"))
        return self

    def predict(self, samples: DataFrame) -> DataFrame:
        """Adds y_pred."""
        model = self.model.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.by)], F.col("intercept").alias("_b"), F.col("weights").alias("_w"))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.by)])
        value = F.col("_b") + _dot([(F.col("_w")[i], F.col(f).cast("double")) for i, f in enumerate(self.features)])
        return samples.join(model, same, "left").withColumn("y_pred", value).select(*samples.columns, "y_pred")


class BoostedOutputs:
    """Gradient-boosted trees of squared error for each output.

    Inputs are cut into bins at quantiles that all outputs share. Each level of each round's trees is one
    aggregate of residuals by (output, node, input, bin) for all outputs; the best split of a node is the one that
    lowers the squared error most, ties to the earlier input and lower bin, with `least` rows on either side. A null input lies in
    the lowest bin, NaN in the highest. Splits are joined to rows as tables; nothing but the bins' bounds reaches the driver.
    """

    def __init__(self, by: list[str], rounds: int = 100, step: float = 0.1, depth: int = 3, bins: int = 32, least: int = 20):
        self.by, self.rounds, self.step, self.depth, self.bins, self.least = list(by), rounds, step, depth, bins, least

    def _binned(self, df: DataFrame) -> Column:
        """Of each input the number of bounds below it."""
        return F.array(*[F.coalesce(reduce(lambda a, b: a + b, [(F.col(f).cast("double") > F.lit(e)).cast("int") for e in self.bounds[f]], F.lit(0)), F.lit(0)) for f in self.features])

    def fit(self, samples: DataFrame, features: list[str]) -> BoostedOutputs:
        by, self.features = self.by, list(features)
        probs = [(i + 1) / self.bins for i in range(self.bins - 1)]
        long = samples.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f).cast("double").alias("v")) for i, f in enumerate(features)])).alias("e")).select("e.*")
        found = {r["i"]: sorted(set(r["q"])) for r in quantiles(long, "v", probs, ["i"]).collect()}  # inputs x bins numbers
        self.bounds = {f: found.get(i, []) for i, f in enumerate(features)}
        rows = samples.where("y is not null").select(*by, self._binned(samples).alias("_bins"), F.col("y").cast("double").alias("_y"))
        base = stored(rows.groupBy(*by).agg(F.avg("_y").alias("base")), "base")
        rows = stored(rows.join(base, by).withColumnRenamed("base", "_f"), "boosting")
        trees = []
        for k in range(self.rounds):
            at = rows.withColumn("_node", F.lit(1))
            for _ in range(self.depth):
                splits = stored(self._splits(at).withColumn("round", F.lit(k)), "splits")
                at = self._routed(at, splits)
                trees.append(splits)
            leaves = stored(at.groupBy(*by, "_node").agg((F.avg(F.col("_y") - F.col("_f")) * self.step).alias("value")).withColumn("round", F.lit(k)), "leaves")
            trees.append(leaves)
            later = stored(at.join(leaves, [*by, "_node"]).select(*by, "_bins", "_y", (F.col("_f") + F.col("value")).alias("_f")), "boosting")
            dropped(rows)
            rows = later
        nodes = [t.select(*by, "round", "_node", *[F.col(c) if c in t.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("input", "int"), ("bin", "int"), ("value", "double"))]) for t in trees]
        whole = reduce(DataFrame.unionAll, nodes).groupBy(*by, "round").agg(F.map_from_entries(F.collect_list(F.struct("_node", F.struct("input", "bin", "value")))).alias("tree"))
        whole = whole.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("round", "tree")), lambda a, b: a["round"] - b["round"]).alias("trees"))  # a model: rounds x 2**(depth + 1) nodes
        self.model = stored(base.join(whole, by, "left"), "model")
        dropped(rows, base, *trees)
        return self

    def _splits(self, at: DataFrame) -> DataFrame:
        """(by, _node, input, bin) of every node that has a split."""
        by = [*self.by, "_node"]
        cells = at.select(*by, (F.col("_y") - F.col("_f")).alias("g"), F.posexplode("_bins").alias("input", "bin")).groupBy(*by, "input", "bin").agg(F.sum("g").alias("g"), F.count("*").alias("n"))
        group = Window.partitionBy(*by, "input")
        low = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.select(*by, "input", "bin", F.sum("g").over(low).alias("gl"), F.sum("n").over(low).alias("nl"), F.sum("g").over(group).alias("g"), F.sum("n").over(group).alias("n"))
        gr, nr = F.col("g") - F.col("gl"), F.col("n") - F.col("nl")
        gain = F.col("gl") * F.col("gl") / F.col("nl") + gr * gr / nr - F.col("g") * F.col("g") / F.col("n")
        cells = cells.where((F.col("nl") >= self.least) & (nr >= self.least)).withColumn("gain", gain).where("gain > 1e-9")
        return cells.groupBy(*by).agg(F.max_by(F.struct("input", "bin"), F.struct("gain", -F.col("input"), -F.col("bin"))).alias("s")).select(*by, "s.input", "s.bin")

    def _routed(self, at: DataFrame, splits: DataFrame) -> DataFrame:
        """Rows moved from nodes that have a split to the child they belong to."""
        columns = [c for c in at.columns if c != "_node"]
        child = 2 * F.col("_node") + (F.get("_bins", F.col("input")) > F.col("bin")).cast("int")
        return at.join(splits.drop("round"), [*self.by, "_node"], "left").select(*columns, F.coalesce(child, "_node").alias("_node"))

    def predict(self, samples: DataFrame) -> DataFrame:
        """Adds y_pred; null for an output that was not learned."""
        model = self.model.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.by)], F.col("base").alias("_base"), F.col("trees").alias("_trees"))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.by)])

        def below(tree: Column, node: Column) -> Column:
            split = F.element_at(tree, node)
            return F.when(split["input"].isNotNull(), 2 * node + (F.get("_bins", split["input"]) > split["bin"]).cast("int")).otherwise(node)

        def value(tree: Column) -> Column:
            leaf = F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(1), lambda node, _: below(tree, node))
            return F.element_at(tree, leaf)["value"]

        total = F.aggregate(F.coalesce("_trees", F.array().cast(model.schema["_trees"].dataType)), F.col("_base"), lambda s, t: s + value(t["tree"]))
        return samples.withColumn("_bins", self._binned(samples)).join(model, same, "left").withColumn("y_pred", total).select(*samples.columns, "y_pred")
