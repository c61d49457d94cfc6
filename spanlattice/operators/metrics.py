"""Evaluation, meters and losses as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlattice.operators.assign import assign
from spanlattice.operators.runs import areas, join_ranges, overlaps, pair_overlaps
from spanlattice.session import Scratch

EPS = 1e-5


def match_instances(gt: DataFrame, pred: DataFrame, keys: list[str], scratch: Scratch, threshold: float | None = None, bucket: int = 1 << 10) -> DataFrame:
    """(keys, gt, pred, iou): the best one-to-one assignment of objects by IoU; keys are equal on both sides.

    ``gt``: (keys, gt, s, e), ``pred``: (keys, pred, s, e), objects' ranges disjoint.
    """
    other = [f"_p_{k}" for k in keys]
    p = pred
    for k, o in zip(keys, other):
        p = p.withColumnRenamed(k, o)
    pairs = pair_overlaps(gt, [*keys, "gt"], p, [*other, "pred"], equal=list(zip(keys, other)), bucket=bucket)
    return assign(pairs.select(*keys, "gt", "pred", "iou"), keys, "gt", "pred", "iou", scratch, threshold)


def match_counts(matched: DataFrame, gt: DataFrame, pred: DataFrame, keys: list[str], threshold: float, match_threshold: float = 0.0) -> DataFrame:
    """(keys, tp, fp, fn, sum_iou) of each key that has an object on either side.

    Pairs of ``matched`` with iou of at least ``match_threshold`` are partners; of those, pairs below ``threshold`` are one false positive and one false
    negative; objects without a partner are one of them.
    """
    partners = matched.filter(F.col("iou") >= match_threshold)
    good = F.col("iou") >= threshold
    m = partners.groupBy(*keys).agg(F.count(F.when(good, 1)).alias("tp"), F.count(F.when(~good, 1)).alias("low"), F.sum(F.when(good, F.col("iou")).otherwise(0.0)).alias("sum_iou"))
    # anti joins: objects without a partner
    lone_gt = gt.select(*keys, "gt").distinct().join(partners.select(*keys, "gt"), [*keys, "gt"], "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("lg"))
    lone_pred = pred.select(*keys, "pred").distinct().join(partners.select(*keys, "pred"), [*keys, "pred"], "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("lp"))
    all_keys = gt.select(*keys).unionAll(pred.select(*keys)).distinct()
    out = all_keys.join(m, keys, "left").join(lone_gt, keys, "left").join(lone_pred, keys, "left").na.fill(0, ["tp", "low", "lg", "lp"]).na.fill(0.0, ["sum_iou"])
    return out.select(*keys, "tp", (F.col("low") + F.col("lp")).alias("fp"), (F.col("low") + F.col("lg")).alias("fn"), "sum_iou")


def instance_scores(counts: DataFrame, keys: list[str]) -> DataFrame:
    """precision, recall, f1, ap = tp / (tp + fp + fn), pq = sq * rq from match_counts; 1 where nothing is there to be found or missed."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(1.0))
    half = tp + 0.5 * fp + 0.5 * fn
    sq = F.col("sum_iou") / (tp + EPS)
    empty = (tp + fp + fn) == 0
    return counts.select(*keys, "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tp, half).alias("f1"), ratio(tp, tp + fp + fn).alias("ap"), F.when(empty, 1.0).otherwise(sq * ratio(tp, half)).alias("pq"))


def semantic_iou(gt: DataFrame, pred: DataFrame, keys: list[str], bucket: int = 1 << 10) -> DataFrame:
    """(keys, iou) of everything covered on either side; keys on one side only have 0. Overlapping ranges of a side count once."""
    g, p = join_ranges(gt, keys), join_ranges(pred, keys)
    other = [f"_p_{k}" for k in keys]
    q = p
    for k, o in zip(keys, other):
        q = q.withColumnRenamed(k, o)
    inter = overlaps(g, keys, q, other, equal=list(zip(keys, other)), bucket=bucket).groupBy(*keys).agg(F.sum("inter").alias("i"))
    sides = areas(g, keys, "ng").join(areas(p, keys, "np"), keys, "full").join(inter, keys, "left").na.fill(0, ["ng", "np", "i"])
    return sides.select(*keys, (F.col("i") / (F.col("ng") + F.col("np") - F.col("i")).cast("double")).alias("iou"))


def evaluate(gt: DataFrame, pred: DataFrame, keys: list[str], thresholds: tuple[float, ...] = (0.5, 0.75), bucket: int = 1 << 10) -> DataFrame:
    """(keys, semantic_iou, pq, and precision_, recall_, f1_, ap_ for each threshold in per cent).

    Objects are matched once, partners from IoU 0.5 on.
    """
    scratch = Scratch(gt.sparkSession, "evaluate")
    matched = scratch.keep(match_instances(gt, pred, keys, scratch, bucket=bucket))
    out = semantic_iou(gt, pred, keys, bucket).withColumnRenamed("iou", "semantic_iou")
    for n, t in enumerate(thresholds):
        scores = instance_scores(match_counts(matched, gt, pred, keys, t, 0.5), keys)
        names = {m: f"{m}_{round(100 * t)}" for m in ("precision", "recall", "f1", "ap")}
        scores = scores.select(*keys, *([] if n else ["pq"]), *[F.col(a).alias(b) for a, b in names.items()])
        out = out.join(scores, keys)
    return scratch.handed(out)


def dense_iou(pixels: DataFrame, keys: list[str], gt: str, pred: str) -> DataFrame:
    """(keys, class, iou) of dense class maps, smoothed by EPS, for each class on either side."""
    sides = pixels.select(*keys, F.explode(F.array_distinct(F.array(gt, pred))).alias("class"), gt, pred)
    both = F.sum(F.when(F.col(gt) == F.col(pred), 1).otherwise(0))
    return sides.groupBy(*keys, "class").agg(((both + EPS) / (F.count(F.lit(1)) + EPS)).alias("iou"))


def ema(df: DataFrame, keys: list[str], order: list[str], value: str, momentum: float = 0.98) -> DataFrame:
    """(keys, n, ema): the bias-corrected exponential mean after the last value. Null values are left out."""
    kept = df.filter(F.col(value).isNotNull())
    at = kept.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    weight = (1 - momentum) * F.pow(F.lit(momentum), F.col("_n") - F.col("_i"))
    return at.groupBy(*keys).agg(F.max("_n").alias("n"), (F.sum(F.col(value) * weight) / F.max(1 - F.pow(F.lit(momentum), F.col("_n")))).alias("ema"))


def averages(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, total) of the values that are not null."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("total"))


def bce(logit: Column, target: Column) -> Column:
    """Binary cross entropy of a logit, in the form that does not overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def cross_entropy(logits: Column, target: Column) -> Column:
    top = F.array_max(logits)
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))) - F.element_at(logits, target + 1)


#: Accuracy of the quantiles between which the last of the hardest lies: it is missed by at most one in ACCURACY of the rows.
ACCURACY = 10_000


def hardest_mean(df: DataFrame, keys: list[str], loss: str, share: float = 0.2) -> DataFrame:
    """(keys, loss): mean of the int(share * n) greatest losses; of all with a share of 1; null if that is none. Null losses are left out.

    Two quantiles of each key enclose the loss of the last one that counts. What is above both is summed up as it is, and only the
    different losses between them, a few in ACCURACY of the rows, are sorted; ties need no order, since they are equal.
    """
    df = df.filter(F.col(loss).isNotNull())
    if share >= 1.0:
        return df.groupBy(*keys).agg(F.avg(loss).alias(loss))
    edge = [max(0.0, 1 - share - 4 / ACCURACY), min(1.0, 1 - share + 4 / ACCURACY)]
    cut = df.groupBy(*keys).agg(F.floor(F.count(F.lit(1)) * share).alias("_k"), F.percentile_approx(loss, edge, ACCURACY).alias("_q"))
    same = [F.col(f"_c_{k}").eqNullSafe(F.col(k)) for k in keys]
    on = same[0]
    for x in same[1:]:
        on = on & x
    # one more rank than counted may be needed on small inputs, where the lower quantile is a row's loss itself
    at = df.join(cut.select(*[F.col(k).alias(f"_c_{k}") for k in keys], "_k", "_q"), on)
    above = F.col(loss) > F.col("_q")[1]
    each = at.filter(F.col(loss) >= F.col("_q")[0]).groupBy(*keys, "_k", F.when(~above, F.col(loss)).alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.sum(loss).alias("_s"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy(F.desc_nulls_first("_v")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    used = each.withColumn("_use", F.greatest(F.least(F.col("_n"), F.col("_k") - before), F.lit(0)))
    part = F.when(F.col("_v").isNull(), F.col("_s")).otherwise(F.col("_use") * F.col("_v"))
    return used.groupBy(*keys).agg((F.sum(part) / F.nullif(F.max("_k"), F.lit(0))).alias(loss))


def squared_error(a: str, b: str) -> Column:
    """Aggregate: mean of (a - b) squared."""
    return F.avg(F.pow(F.col(a) - F.col(b), 2))


def masked_l1(a: list[str], b: list[str], weight: str) -> Column:
    """Aggregate: sum of weighted absolute differences over all channels by the sum of weights; 0 if that is 0."""
    diff = sum((F.abs(F.col(x) - F.col(y)) for x, y in zip(a[1:], b[1:])), F.abs(F.col(a[0]) - F.col(b[0])))
    return F.coalesce(F.sum(diff * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0)), F.lit(0.0))


def panoptic_loss(ce: Column, mse: Column, l1: Column, point: Column | None = None, weights: tuple[float, float, float, float] = (1.0, 200.0, 0.01, 1.0)) -> Column:
    total = ce * weights[0] + mse * weights[1] + l1 * weights[2]
    return total if point is None else total + point * weights[3]


def mask_overlaps(pixels: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, a, b, inter, iou, ioa) of the labels above 0 of two label columns of the same pixels; ioa is the share of b's mask."""
    pairs = pixels.filter((F.col(a) > 0) & (F.col(b) > 0)).groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("inter"))
    na = pixels.filter(F.col(a) > 0).groupBy(*keys, a).agg(F.count(F.lit(1)).alias("_na"))
    nb = pixels.filter(F.col(b) > 0).groupBy(*keys, b).agg(F.count(F.lit(1)).alias("_nb"))
    out = pairs.join(na, [*keys, a]).join(nb, [*keys, b])
    iou = F.col("inter") / (F.col("_na") + F.col("_nb") - F.col("inter")).cast("double")
    return out.select(*keys, a, b, "inter", iou.alias("iou"), (F.col("inter") / F.col("_nb").cast("double")).alias("ioa"))


def dense_scores(pixels: DataFrame, keys: list[str], gt: str, pred: str, threshold: float = 0.5) -> DataFrame:
    """instance_scores of dense label images (0 is background), objects matched by mask IoU."""
    scratch = Scratch(pixels.sparkSession, "scores")
    pairs = mask_overlaps(pixels, keys, gt, pred).select(*keys, F.col(gt).cast("bigint").alias("gt"), F.col(pred).cast("bigint").alias("pred"), "iou")
    matched = scratch.keep(assign(pairs, keys, "gt", "pred", "iou", scratch))
    side = lambda c, as_: pixels.filter(F.col(c) > 0).select(*keys, F.col(c).cast("bigint").alias(as_)).distinct()
    return scratch.handed(instance_scores(match_counts(matched, side(gt, "gt"), side(pred, "pred"), keys, threshold, threshold), keys))


def point_loss(points: DataFrame, keys: list[str], logit: str, target: str) -> DataFrame:
    """(keys, loss): mean binary cross entropy of logits at sampled points; targets from image.point_sample(..., mode='nearest')."""
    return points.groupBy(*keys).agg(F.avg(bce(F.col(logit), F.col(target).cast("double"))).alias("loss"))


def contour_loss(semantic: Column, contour: Column, points: Column | None = None, point_weight: float = 1.0) -> Column:
    """Sum of the two hardest-pixel losses, and of the point losses if there are any."""
    total = semantic + contour
    return total if points is None else total + points * point_weight


def history(values: DataFrame, epoch: str, metric: str, cls: str, value: str) -> DataFrame:
    """(epoch, metric, class, average, count): named averages per class, one row for each epoch; the class is null for the mean over all."""
    each = values.groupBy(epoch, metric, F.col(cls).cast("string").alias("class")).agg(F.avg(value).alias("average"), F.count(value).alias("count"))
    over = each.groupBy(epoch, metric).agg(F.avg("average").alias("average"), F.sum("count").alias("count"))
    return each.unionByName(over.withColumn("class", F.lit(None).cast("string")))
