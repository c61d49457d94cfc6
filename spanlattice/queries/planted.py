"""Queries on planted objects whose right result is known, so that SQL can state what tracking, consensus and floods must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlattice.functions.rle import ravel, unravel
from spanlattice.operators import consensus, metrics, track, watershed
from spanlattice.operators.boxes import D2
from spanlattice.plans.orthoplane import segment_objects
from spanlattice.queries import Registry
from spanlattice.session import Scratch, table

registry = Registry()

# --- tracks: an object k of a stack drifts by 10 of its 100 indices from slice to slice, under another label in each; every fifth appears in slice 3 only

_TRACKS = """obj as (select distinct l_suppkey stack, l_partkey % 40 k from lineitem),
seen as (select stack, k, z, 1000 * k + 10 * z s, (k * 7 + z * 13) % 41 + 1 label from (select *, unnest(range(0, 6)) z from obj) where k % 5 <> 0 or z >= 3)"""


def _planted(spark, sf_dir):
    obj = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("stack"), (F.col("l_partkey") % 40).alias("k")).distinct()
    seen = obj.select("stack", "k", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("slice")).filter("k % 5 <> 0 or slice >= 3")
    label = (F.col("k") * 7 + F.col("slice") * 13) % 41 + 1
    return seen.select("stack", F.lit(0).alias("class_id"), "slice", label.alias("label"), F.array(1000 * F.col("k") + 10 * F.col("slice")).alias("starts"), F.array(F.lit(100).cast("bigint")).alias("runs"))


def _tracked(df):
    return df.select("stack", "slice", "label", F.col("starts")[0].alias("s"))


@registry.query("track_forward_planted", f"""with {_TRACKS}, a as (select stack, k, label from seen where z = 0), m as (select stack, max(label) top from a group by 1),
late as (select seen.stack, k, label, row_number() over (partition by seen.stack order by label) r, m.top from seen left join m on m.stack = seen.stack where z = 3 and k % 5 = 0),
named as (select stack, k, label from a union all select stack, k, case when top is null then label else top + r end from late)
select stack, cast(z as integer) slice, cast(n.label as bigint) label, cast(s as bigint) s from seen join named n using (stack, k)""")
def track_forward_planted(spark, sf_dir):
    """Labels of the first slice hold; what appears later gets the next ones, in the order of its own labels."""
    return _tracked(track.track_forward(_planted(spark, sf_dir), ["stack", "class_id"], 1000))


@registry.query("track_backward_planted", f"with {_TRACKS} select a.stack, cast(a.z as integer) slice, cast(b.label as bigint) label, cast(a.s as bigint) s from seen a join seen b on a.stack = b.stack and a.k = b.k and b.z = 5")
def track_backward_planted(spark, sf_dir):
    """The labels of the last slice hold in all before."""
    return _tracked(track.track_backward(_planted(spark, sf_dir), ["stack", "class_id"], 1000))


# --- consensus: an order is seen by one, two or three of three sources, shifted by 5 from each to the next; or as two halves by two of them, and whole by the third


_SIGHTS = """o as (select distinct l_orderkey k from lineitem),
sights as (select k, src, 0 half, 1000 * k + 5 * src s, 1000 * k + 5 * src + 100 e from (select *, unnest(range(0, 3)) src from o) where k % 5 < 3 and src <= k % 5
  union all select k, src, half, 1000 * k + 50 * half, 1000 * k + 50 * half + 50 from (select *, unnest(range(0, 2)) src from o), (select unnest(range(0, 2)) half) where k % 5 >= 3
  union all select k, 2, 0, 1000 * k, 1000 * k + 100 from o where k % 5 >= 3)"""


def _sights(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    row = lambda src, half, s, e: F.struct(F.lit(src).alias("source"), F.lit(half).alias("half"), (1000 * F.col("k") + s).alias("s"), (1000 * F.col("k") + e).alias("e"))
    few = F.slice(F.array(*[row(j, 0, 5 * j, 5 * j + 100) for j in range(3)]), F.lit(1), (F.col("k") % 5 + 1).cast("int"))
    halves = F.array(*[row(j, h, 50 * h, 50 * h + 50) for j in range(2) for h in range(2)], row(2, 0, 0, 100))
    x = o.select("k", F.explode(F.when(F.col("k") % 5 < 3, few).otherwise(halves)).alias("x")).select("k", "x.*")
    x = x.withColumn("node", F.col("k") * 10 + F.col("half") * 3 + F.col("source"))
    boxes = x.select("node", "source", F.lit(0).cast("bigint").alias("y1"), F.col("s").alias("x1"), F.lit(1).cast("bigint").alias("y2"), F.col("e").alias("x2"))
    return boxes, x.select("node", "s", "e")


@registry.query("consensus_planted", """with o as (select distinct l_orderkey k from lineitem),
found as (select k, 1000 * k + 5 s, 1000 * k + 100 + 5 * (k % 5 - 1) e from o where k % 5 in (1, 2) union all select k, 1000 * k + 50 * half, 1000 * k + 50 * half + 50 from o, (select unnest(range(0, 2)) half) where k % 5 >= 3)
select row_number() over (order by k, s) instance, s, e from found""")
def consensus_planted(spark, sf_dir):
    """Seen by one source: dropped. By two or three: what two of them cover. As halves by two and whole by one: the whole,
    a smaller cluster between two greater ones, goes to both of them."""
    boxes, runs = _sights(spark, sf_dir)
    return consensus.Consensus(boxes, runs, 3, votes=2, cluster_iou=0.75, dims=D2, bucket=256).runs


# --- flood: a square of 4 x 4 for each customer, its upper and left rim foreground only


@registry.query("watershed_planted", """with c as (select c_custkey k, row_number() over (order by c_custkey) r from customer)
select cast(0 as integer) z, cast(6 * (k // 50) + i as integer) y, cast(6 * (k % 50) + j as integer) x, cast(1000 + r as bigint) as label from c, (select unnest(range(0, 4)) i), (select unnest(range(0, 4)) j)""")
def watershed_planted(spark, sf_dir):
    at = lambda name: F.explode(F.sequence(F.lit(0), F.lit(3))).alias(name)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).select("k", at("i")).select("k", "i", at("j"))
    row = F.call_function("div", F.col("k"), F.lit(50).cast("bigint"))
    v = c.select(F.lit(0).alias("z"), (6 * row + F.col("i")).cast("int").alias("y"), (6 * (F.col("k") % 50) + F.col("j")).cast("int").alias("x"), F.when((F.col("i") == 0) | (F.col("j") == 0), 220).otherwise(250).alias("sem"), F.lit(10).alias("bd"))
    return watershed.contour_watershed(v, seed_size=8, min_size=12)


# --- scores: five objects in each of five slices, a fifth of the pixels of each given to none


@registry.query("dense_scores_planted", """with p as (select o_orderkey % 5 k, o_custkey % 6 gt, case when o_custkey % 6 > 0 and o_orderkey % 10 < 8 then o_custkey % 6 + 10 else 0 end pred from orders),
g as (select k, gt, count(*) n from p where gt > 0 group by 1, 2), r as (select k, pred, count(*) n from p where pred > 0 group by 1, 2), i as (select k, gt, count(*) n from p where gt > 0 and pred = gt + 10 group by 1, 2),
m as (select g.k, g.gt, i.n / cast(g.n + r.n - i.n as double) iou from g join i using (k, gt) join r on r.k = g.k and r.pred = g.gt + 10),
t as (select k, count(*) filter (iou >= 0.9) tp, coalesce(sum(iou) filter (iou >= 0.9), 0) si from m group by 1),
c as (select k, cast(tp as bigint) tp, (select count(*) from r where r.k = t.k) - tp fp, (select count(*) from g where g.k = t.k) - tp fn, si from t)
select k, tp, fp, fn, case when tp + fp = 0 then 1 else tp / cast(tp + fp as double) end as precision, case when tp + fn = 0 then 1 else tp / cast(tp + fn as double) end recall,
  round(tp / (tp + 0.5::double * fp + 0.5::double * fn), 9) f1, round(tp / cast(tp + fp + fn as double), 9) ap, round(si / (tp + 0.00001::double) * (tp / (tp + 0.5::double * fp + 0.5::double * fn)), 9) pq from c""")
def dense_scores_planted(spark, sf_dir):
    """At an IoU of 0.9: of some slices all pixels are given to their object, of others three in five."""
    o = table(spark, sf_dir, "orders")
    gt = (F.col("o_custkey") % 6).cast("int")
    px = o.select((F.col("o_orderkey") % 5).alias("k"), gt.alias("gt"), F.when((gt > 0) & (F.col("o_orderkey") % 10 < 8), gt + 10).otherwise(0).alias("pred"))
    got = metrics.dense_scores(px, ["k"], "gt", "pred", 0.9)
    return got.select("k", "tp", "fp", "fn", "precision", "recall", *[F.round(c, 9).alias(c) for c in ("f1", "ap", "pq")])


# --- indices and boxes


@registry.query("ravel_corners", "select distinct object_id, cast(z1 as bigint) * 5000 + y1 % 50 * 100 + x1 % 100 idx, cast(z1 as bigint) z, cast(y1 % 50 as bigint) y, cast(x1 % 100 as bigint) x from tracked_object where z1 >= 0 and y1 >= 0 and x1 >= 0")
def ravel_corners(spark, sf_dir):
    """Box corners as indices of slices of 50 x 100, and back."""
    o = table(spark, sf_dir, "tracked_object").filter("z1 >= 0 and y1 >= 0 and x1 >= 0")
    idx = ravel(F.col("z1").cast("bigint"), F.col("y1") % 50, F.col("x1") % 100, 50, 100)
    back = o.select("object_id", idx.alias("idx")).withColumn("p", unravel(F.col("idx"), 50, 100))
    return back.select("object_id", "idx", "p.z", "p.y", "p.x").distinct()


@registry.query("lift_boxes", """select src, label, min(y1) z1, min(z1) y1, min(x1) x1, max(y2) z2, max(z1) + 1 y2, max(x2) x2 from tracked_object where z1 is not null and y1 is not null and x1 is not null and y2 is not null and x2 is not null group by 1, 2""")
def lift_boxes(spark, sf_dir):
    """2D boxes in slices across y as boxes of the volume; the slice is the object's first z here."""
    o = table(spark, sf_dir, "tracked_object").select("src", "label", F.col("z1").alias("slice"), "y1", "x1", "y2", "x2").dropna()
    return track.lift_boxes(o, ["src"], "xz")


# --- from probabilities to slice objects: squares of 6 x 6 around known centres


@registry.query("segment_planted", """with c as (select c_custkey k, c_nationkey slice from customer), r as (select k, slice, row_number() over (partition by slice order by k) n from c)
select slice, cast(1000 + n as bigint) as label, cast(36 as bigint) area, cast(8 * k as bigint) x1 from r""")
def segment_planted(spark, sf_dir):
    """A class 1 square for each customer in the slice of its nation, from class probabilities, heat and offsets through median, grouping, merge and connected parts to runs."""
    at = lambda name: F.explode(F.sequence(F.lit(0), F.lit(5))).alias(name)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("slice")).select("k", "slice", at("i")).select("k", "slice", "i", at("j"))
    heat = F.when((F.col("i") == 3) & (F.col("j") == 3), 1.0).otherwise(0.0)
    px = c.select("slice", F.col("i").alias("y"), (8 * F.col("k") + F.col("j")).alias("x"), F.array(F.lit(0.2), F.lit(0.8)).alias("sem"), heat.alias("heat"), (3.0 - F.col("i")).alias("off_y"), (3.0 - F.col("j")).alias("off_x"))
    got = segment_objects(px, [], 8_000_000, 1000, [1], Scratch(spark, "segment"), stuff_area=1, nms_kernel=3, cell=8.0)
    size = F.aggregate("runs", F.lit(0).cast("bigint"), lambda a, r: a + r)
    return got.select("slice", "label", size.alias("area"), F.pmod(F.col("starts")[0], F.lit(8_000_000)).alias("x1"))
