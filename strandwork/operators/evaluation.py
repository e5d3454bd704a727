"""Classifier measures over scored rows: ``class_id`` (0 is positive), ``score`` and ``weight``.

Everything starts from one reduction: weights per distinct score. Its running sums (``curve``) come from
``ordered.running_total``, so no measure sorts all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwork.operators.ordered import running_total
from strandwork.operators.sets import folds


def curve(df: DataFrame) -> DataFrame:
    """A row for each distinct score, from the highest down: weights ``p, n`` there, ``tp, fp`` down to it."""
    per = df.groupBy("score").agg(F.sum(F.when(F.col("class_id") == 0, F.col("weight")).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("class_id") != 0, F.col("weight")).otherwise(0.0)).alias("n"))
    return running_total(per, "score", ["p", "n"], ascending=False).withColumnsRenamed({"cum_p": "tp", "cum_n": "fp"})


def rates(df: DataFrame) -> DataFrame:
    """``score, tpr, fpr, precision`` from the highest score down: the points of both curves."""
    t = _totals(df).first()
    return curve(df).select("score", (F.col("tp") / t["pos"]).alias("tpr"), (F.col("fp") / t["neg"]).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def merged_classes(df: DataFrame, class_col: str, to: dict) -> DataFrame:
    """``df`` with ``class_id``: classes taken together (null: not among them)."""
    table = F.create_map(*(F.lit(x) for pair in to.items() for x in pair))
    return df.withColumn("class_id", F.try_element_at(table, F.col(class_col)))


def _totals(df: DataFrame):
    return df.agg(F.sum(F.when(F.col("class_id") == 0, F.col("weight")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("class_id") != 0, F.col("weight")).otherwise(0.0)).alias("neg"))


def auc_roc(df: DataFrame) -> DataFrame:
    """Probability that a positive scores above a negative, ties half."""
    area = curve(df).agg(F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)).alias("area"))
    t = _totals(df).first()
    return area.select((F.col("area") / (t["pos"] * t["neg"])).alias("auc_roc"))


def auc_pr(df: DataFrame) -> DataFrame:
    """Area under precision over recall, each segment between neighbouring scores integrated in closed form."""
    t = _totals(df).first()
    c = curve(df).select("score", "p", "n", "tp", "fp")
    # within a segment: fp = fp0 + h * (tp - tp0), h = n / p; precision = tp / (tp + fp)
    tp0, fp0 = F.col("tp") - F.col("p"), F.col("fp") - F.col("n")
    h = F.col("n") / F.col("p")
    a, b = 1 + h, fp0 - h * tp0
    whole = F.col("p") / a - b / (a * a) * (F.log(a * F.col("tp") + b) - F.log(a * tp0 + b))
    straight = F.col("p") / a  # b = 0, so precision is constant
    piece = F.when(F.col("p") == 0, 0.0).when(F.abs(b) < 1e-12, straight).when(a * tp0 + b <= 0, straight).otherwise(whole)
    return c.agg((F.sum(piece) / t["pos"]).alias("auc_pr"))


def threshold_measures(df: DataFrame, beta: float = 1.0) -> DataFrame:
    """``max_f, max_mcc`` over all distinct thresholds (positive: score >= threshold)."""
    t = _totals(df).first()
    pos, neg = t["pos"], t["neg"]
    tp, fp = F.col("tp"), F.col("fp")
    f = (1 + beta**2) * tp / (beta**2 * pos + tp + fp)
    tn, fn = neg - fp, pos - tp
    below = (tp + fp) * pos * neg * (tn + fn)
    mcc = F.when(below <= 0, 0.0).otherwise((tp * tn - fp * fn) / F.sqrt(below))
    return curve(df).agg(F.max(f).alias("max_f"), F.max(mcc).alias("max_mcc"))


def at_sensitivity(df: DataFrame, least: float) -> DataFrame:
    """``threshold, fpr, ppv`` at the highest threshold whose sensitivity reaches ``least``."""
    t = _totals(df).first()
    hit = curve(df).where(F.col("tp") >= least * t["pos"]).agg(F.max_by(F.struct("score", "tp", "fp"), "score").alias("x"))
    return hit.select(F.col("x.score").alias("threshold"), (F.col("x.fp") / t["neg"]).alias("fpr"), (F.col("x.tp") / (F.col("x.tp") + F.col("x.fp"))).alias("ppv"))


def at_specificity(df: DataFrame, least: float) -> DataFrame:
    """``threshold, sensitivity`` at the lowest threshold whose specificity is still at least ``least``."""
    t = _totals(df).first()
    hit = curve(df).where(F.col("fp") <= (1 - least) * t["neg"]).agg(F.min_by(F.struct("score", "tp"), "score").alias("x"))
    return hit.select(F.col("x.score").alias("threshold"), (F.col("x.tp") / t["pos"]).alias("sensitivity"))


def classification_rate(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    right = (F.col("class_id") == 0) == (F.col("score") >= threshold)
    return df.agg((F.sum(F.when(right, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("rate"))


def confusion(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    return df.groupBy("class_id", F.when(F.col("score") >= threshold, 0).otherwise(1).alias("predicted")).agg(F.sum("weight").alias("weight"))


def empirical_p(df: DataFrame, background: DataFrame, score: str) -> DataFrame:
    """``df`` with ``p``: the share of background scores that are at least as high."""
    total = background.count()
    both = background.groupBy(score).agg(F.count("*").alias("n")).unionByName(df.select(score).distinct().withColumn("n", F.lit(0).cast("bigint")))
    per = both.groupBy(score).agg(F.sum("n").alias("n"))
    tail = running_total(per, score, ["n"], ascending=False).select(F.col(score).alias("__s"), (F.col("cum_n") / total).alias("p"))
    return df.join(tail, F.col(score) == F.col("__s")).drop("__s")


MEASURES = {"auc_roc": auc_roc, "auc_pr": auc_pr, "rate": classification_rate, "thresholds": threshold_measures}


def evaluate(df: DataFrame, measures: dict = MEASURES) -> dict:
    return {name: m(df).first().asDict() for name, m in measures.items()}


def cross_validate(df: DataFrame, id_col: str, k: int, fit, score, seed: int = 0) -> list[dict]:
    """``fit(train) -> model``, ``score(model, test) -> scored rows``; a dictionary of measures for each fold."""
    dealt = folds(df, id_col, k, seed)
    return [evaluate(score(fit(dealt.where(F.col("fold") != i)), dealt.where(F.col("fold") == i))) for i in range(k)]


def argmax_class(scores: list[str]):
    """Number of the largest of some score columns; the first wins ties."""
    every = F.array(*scores)
    return F.array_position(every, F.array_max(every)) - 1


def per_class_rank(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("class_id").orderBy(F.desc("score"))))
