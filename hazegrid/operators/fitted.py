"""Fitted models as small tables, and predictions from them as column expressions.

A linear model is fitted here from sums that tasks add up and merge. A tree ensemble that Spark fitted becomes a table of nodes.
Either can be stored, read by anything that reads Parquet, and evaluated inside another expression, such as the fold over the coming
hours of a recursive forecast.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.session import scratch_path

# A prediction from named feature columns.
Predict = Callable[[Mapping[str, Column]], Column]
# A feature whose variance is below this share of its squared mean, or that the features before it explain but for this share, has no weight.
FLAT = 1e-12
EXPLAINED = 1e-9


# ---- linear regression from moments -----------------------------------------------------

def moments(df: DataFrame, features: Sequence[str], label: str = "target") -> DataFrame:
    """One row: number of complete rows, means of features and label (``mean``, label last) and the upper half of their covariance matrix
    row by row (``cov``). One aggregation, merged from centred partial sums; rows with a null in any of the columns are left out."""
    names = [*features, label]
    whole = df.select(*[F.col(c).cast("double").alias(c) for c in names]).na.drop()
    pairs = [F.covar_pop(a, b) for i, a in enumerate(names) for b in names[i:]]
    return whole.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in names]).alias("mean"), F.array(*pairs).alias("cov"))


def solved(matrix: Column, n: int) -> Column:
    """The solution of `n` linear equations as an array. `matrix` is symmetric and positive, with ones or zeros in the diagonal and the right-hand
    side as last column. Gauss-Jordan elimination as one fold; an unknown that those before it determine is zero."""
    def step(m: Column, k: Column) -> Column:
        pivot = m[k][k]
        row = F.transform(m[k], lambda x: F.when(pivot > EXPLAINED, x / pivot).otherwise(0.0))
        return F.transform(m, lambda r, i: F.when(i == k, row).otherwise(F.zip_with(r, row, lambda a, b: a - r[k] * b)))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), matrix, step)
    return F.transform(done, lambda r: r[n])


def fit_linear(df: DataFrame, features: Sequence[str], label: str = "target") -> DataFrame:
    """Least squares by the normal equations of the standardised features: one row with ``n``, ``features``, ``coefficients`` and ``intercept``.

    Lazy, one pass over `df`, and nothing but the row of moments meets. Constant features and those that earlier ones explain get weight zero. Without
    complete rows the intercept is null."""
    k = len(features)
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    place = {pair: at for at, (i, j) in enumerate(pairs) for pair in ((i, j), (j, i))}
    cov, mean = F.col("cov"), F.col("mean")
    spread = F.array(*[F.when(cov[place[i, i]] > FLAT * mean[i] * mean[i], F.sqrt(cov[place[i, i]])).otherwise(0.0) for i in range(k + 1)])
    known = moments(df, features, label).withColumn("sd", spread)
    sd = F.col("sd")
    share = [F.array(*[F.coalesce(F.try_divide(cov[place[i, j]], sd[i] * sd[j]), F.lit(0.0)) if i != j else F.when(sd[i] > 0, 1.0).otherwise(0.0)
                       for j in range(k + 1)]) for i in range(k)]
    weights = known.withColumn("w", solved(F.array(*share), k)).withColumn(
        "coefficients", F.transform("w", lambda x, i: F.coalesce(F.try_divide(x * sd[k], sd[i]), F.lit(0.0))))
    explained = F.aggregate(F.zip_with("coefficients", F.slice(mean, 1, k), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return weights.select("n", F.array(*[F.lit(c) for c in features]).alias("features"), "coefficients", (mean[k] - explained).alias("intercept"))


def linear(model: Column, features: Sequence[str]) -> Predict:
    """Prediction from a struct column with ``coefficients`` and ``intercept``."""
    def predict(x: Mapping[str, Column]) -> Column:
        out = model["intercept"]
        for i, c in enumerate(features):
            out = out + model["coefficients"][i] * x[c].cast("double")
        return out
    return predict


# ---- tree ensembles as node tables ------------------------------------------------------

def node_table(model: PipelineModel) -> DataFrame:
    """Nodes of the fitted tree ensemble that ends `model`: tree, node, feature (name, null in a leaf), split (values up to it go left), left, right, value,
    gain, weight_of_rows, and the tree's weight. Reads what the model saves, so nothing passes through the driver; runs that job."""
    spark = SparkSession.active()
    path = scratch_path(spark, "trees")
    model.stages[-1].write().save(path)
    data, trees = spark.read.parquet(f"{path}/data"), spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "about", "tree_weight")
    names = F.array(*[F.lit(c) for c in model.stages[0].getInputCols()])
    d, leaf = F.col("nodeData"), F.col("nodeData.leftChild") < 0
    # a forest predicts the mean of its trees, whatever weights it saves
    mean = F.lit("GBT" not in type(model.stages[-1]).__name__)
    weight = F.when(mean, 1.0 / F.lit(float(model.stages[-1].getNumTrees))).otherwise(F.col("tree_weight"))
    return data.join(trees, data["treeID"] == trees["tree"]).select(
        "tree", d["id"].alias("node"), F.when(~leaf, F.get(names, d["split"]["featureIndex"])).alias("feature"),
        F.when(~leaf, d["split"]["leftCategoriesOrThreshold"][0]).alias("split"), F.when(~leaf, d["leftChild"]).alias("left"),
        F.when(~leaf, d["rightChild"]).alias("right"), d["prediction"].alias("value"), F.when(~leaf, d["gain"]).alias("gain"),
        d["impurityStats"][0].alias("weight_of_rows"), weight.alias("tree_weight"))


def folded_trees(nodes: DataFrame) -> DataFrame:
    """One row with ``trees``: an array over the trees of their weight and nodes by number. As large as the model, whatever the data."""
    node = F.struct("node", "feature", "split", "left", "right", "value")
    per_tree = nodes.groupBy("tree", "tree_weight").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    return per_tree.agg(F.sort_array(F.collect_list(F.struct("tree", F.col("tree_weight").alias("weight"), "nodes"))).alias("trees"))


def forest(trees: Column, features: Sequence[str], depth: int) -> Predict:
    """Prediction of an ensemble from the array that `folded_trees` gives: every tree is walked from its root, `depth` steps at most."""
    def predict(x: Mapping[str, Column]) -> Column:
        values = F.create_map(*[e for c in features for e in (F.lit(c), x[c].cast("double"))])

        def walk(nodes: Column) -> Column:
            def step(at: Column, _: Column) -> Column:
                return F.when(at["left"].isNull(), at).otherwise(
                    F.when(values[at["feature"]] <= at["split"], nodes[at["left"]]).otherwise(nodes[at["right"]]))
            return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), nodes[0], step)["value"]

        return F.aggregate(trees, F.lit(0.0), lambda total, t: total + t["weight"] * walk(t["nodes"]))
    return predict


def tree_importance(nodes: DataFrame, per_tree: bool = True) -> DataFrame:
    """feature, importance: the gains that splits on the feature make, weighted by the rows that reach them, scaled to one over the features. With `per_tree` (forests)
    each tree's gains are first scaled to one, without (boosting) they are added up as they are. Features without a split are missing."""
    gains = nodes.where("feature is not null").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("weight_of_rows")).alias("g"))
    if per_tree:
        whole = gains.groupBy("tree").agg(F.sum("g").alias("all")).withColumnRenamed("tree", "t")
        gains = gains.join(whole, F.col("tree") == F.col("t")).withColumn("g", F.try_divide("g", "all"))
    sums = gains.groupBy("feature").agg(F.sum("g").alias("s"))
    return sums.select("feature", F.try_divide("s", sums.select(F.sum("s")).scalar()).alias("importance"))


# ---- scoring ----------------------------------------------------------------------------

def with_row(df: DataFrame, one: DataFrame, name: str) -> DataFrame:
    """`df` with the single row of `one` as a struct column, read as a scalar subquery."""
    return df.withColumn(name, one.select(F.struct(*one.columns)).scalar())


def score_linear(df: DataFrame, model: DataFrame, features: Sequence[str], prediction: str = "prediction") -> DataFrame:
    """`df` with the prediction of a model of `fit_linear`."""
    out = with_row(df, model, "_model")
    return out.withColumn(prediction, linear(F.col("_model"), features)({c: F.col(c) for c in features})).drop("_model")


def score_forest(df: DataFrame, nodes: DataFrame, features: Sequence[str], depth: int, prediction: str = "prediction") -> DataFrame:
    """`df` with the prediction of a node table, which is read as a scalar subquery."""
    out = with_row(df, folded_trees(nodes), "_model")
    return out.withColumn(prediction, forest(F.col("_model.trees"), features, depth)({c: F.col(c) for c in features})).drop("_model")


def predictor(model: PipelineModel | DataFrame, features: Sequence[str] | None = None) -> tuple[DataFrame, Callable[[Column], Predict]]:
    """The single row that holds `model`, and what turns that row into predictions. `model` is a fitted pipeline (linear or trees) or a row of `fit_linear`, which
    needs its `features` named."""
    if isinstance(model, DataFrame):
        return model.select("coefficients", "intercept"), lambda m: linear(m, features)
    names, last = list(model.stages[0].getInputCols()), model.stages[-1]
    if hasattr(last, "coefficients"):
        row = SparkSession.active().range(1).select(
            F.array(*[F.lit(float(v)) for v in last.coefficients.toArray()]).alias("coefficients"), F.lit(float(last.intercept)).alias("intercept"))
        return row, lambda m: linear(m, names)
    return folded_trees(node_table(model)), lambda m: forest(m["trees"], names, last.getMaxDepth())
