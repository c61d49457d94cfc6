"""Queries on pixel tables and slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlattice.operators import image, metrics, watershed
from spanlattice.plans import registry as registry_of
from spanlattice.queries import Registry
from spanlattice.session import Scratch, table
from spanlattice.sources import arrays, images, volume
from spanlattice.streaming import median

registry = Registry()
DIVISOR = 1000

# pixels: 7 slices of lineitem (one for each line number), y = supplier, x = part modulo 64, with a panoptic id
_PIXELS = "px as (select l_linenumber slice, l_suppkey y, cast(l_partkey % 64 as integer) x, max((1 + l_orderkey % 3) * 1000 + cast(l_quantity as bigint)) pan from lineitem group by 1, 2, 3)"


def pixels(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    pan = (1 + F.col("l_orderkey") % 3) * DIVISOR + F.col("l_quantity").cast("bigint")
    return li.groupBy(F.col("l_linenumber").alias("slice"), F.col("l_suppkey").alias("y"), (F.col("l_partkey") % 64).cast("int").alias("x")).agg(F.max(pan).alias("pan"))


# a dense image for each line number: supplier modulo 97 by part modulo 64, the label being 0 to 4, 0 where there is no line
_DENSE = """cells as (select l_linenumber slice, l_suppkey % 97 y, l_partkey % 64 x, max(l_orderkey % 5) label, max(l_quantity) v from lineitem group by 1, 2, 3),
grid as (select s.slice, y.y, x.x from (select distinct l_linenumber slice from lineitem) s, (select unnest(range(0, 97)) y) y, (select unnest(range(0, 64)) x) x),
dense as (select g.slice, cast(g.y as integer) y, cast(g.x as integer) x, cast(coalesce(c.label, 0) as integer) label, cast(coalesce(c.v, 0) as double) v from grid g left join cells c on c.slice = g.slice and c.y = g.y and c.x = g.x)"""


def dense(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    cells = li.groupBy(F.col("l_linenumber").alias("slice"), (F.col("l_suppkey") % 97).cast("int").alias("y"), (F.col("l_partkey") % 64).cast("int").alias("x")).agg(F.max(F.col("l_orderkey") % 5).cast("int").alias("label"), F.max("l_quantity").cast("double").alias("v"))
    grid = li.select(F.col("l_linenumber").alias("slice")).distinct().select("slice", F.explode(F.sequence(F.lit(0), F.lit(96))).alias("y")).select("slice", "y", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x"))
    return grid.join(cells, ["slice", "y", "x"], "left").na.fill(0, ["label"]).na.fill(0.0, ["v"])


@registry.query("region_props", f"with {_PIXELS} select slice, pan, min(y) y1, min(x) x1, max(y) + 1 y2, max(x) + 1 x2, count(*) area, round(avg(y), 9) cy, round(avg(x), 9) cx from px where pan >= 1000 and pan < 3000 group by 1, 2")
def region_props(spark, sf_dir):
    """Box, area and centroid of the regions of classes 1 and 2."""
    kept = image.class_filter(pixels(spark, sf_dir), "pan", [1, 2], DIVISOR)
    got = image.region_properties(kept, ["slice", "pan"])
    return got.withColumn("cy", F.round("cy", 9)).withColumn("cx", F.round("cx", 9))


@registry.query("crop_binarize", f"with {_PIXELS} select slice, y - 10 y, x - 5 x, cast(pan // 1000 = 2 as integer) mask from px where y >= 10 and y < 70 and x >= 5 and x < 60")
def crop_binarize(spark, sf_dir):
    inside = image.crop(pixels(spark, sf_dir), 10, 5, 70, 60)
    return inside.select("slice", "y", "x", (image.class_of("pan", DIVISOR) == 2).cast("int").alias("mask"))


@registry.query("drop_small_regions", f"with {_PIXELS} select slice, y, x, pan from px where (slice, pan) in (select slice, pan from px group by 1, 2 having count(*) >= 20)")
def drop_small_regions(spark, sf_dir):
    return watershed.drop_small(pixels(spark, sf_dir), ["slice", "pan"], 20).select("slice", "y", "x", "pan")


@registry.query("axis_slices", f"with {_PIXELS} select y slice, slice y, x, pan from px")
def axis_slices(spark, sf_dir):
    """The same voxels as slices across y."""
    return volume.slices(pixels(spark, sf_dir).withColumnRenamed("slice", "z"), "xz")


@registry.query("axis_put", f"with {_PIXELS} select slice z, y, x, pan as value from px where y <> 7 union all select y z, 7 y, x, pan from px where slice = 3")
def axis_put(spark, sf_dir):
    """Slice 3 across z put in as slice 7 across y."""
    v = pixels(spark, sf_dir).select(F.col("slice").alias("z"), "y", "x", F.col("pan").alias("value"))
    taken = volume.slices(v, "xy", 3).select(F.col("y"), "x", "value")
    return volume.put_slice(v, taken, "xz", 7)


@registry.query("panoptic_view", f"with {_PIXELS} select slice, y, x, case when pan // 1000 in (1, 2) then cast(pan // 1000 as bigint) else 0 end sem, case when pan // 1000 = 2 then pan else 0 end thing from px")
def panoptic_view(spark, sf_dir):
    return images.panoptic_view(pixels(spark, sf_dir), [1, 2], [2], DIVISOR)


_SEM = "sem as (select *, [(y % 7) / 7.0, (x % 5) / 5.0, (pan % 11) / 11.0]::double[] p, (pan % 50 - 25) / 10.0 logit from px)"


def _sem(spark, sf_dir):
    n = lambda c, k: (F.col(c) % k).cast("double") / F.lit(float(k))
    return pixels(spark, sf_dir).withColumn("p", F.array(n("y", 7), n("x", 5), n("pan", 11))).withColumn("logit", ((F.col("pan") % 50) - 25) / F.lit(10.0))


@registry.query("harden", f"with {_PIXELS}, {_SEM} select slice, y, x, cast(list_position(p, list_max(p)) - 1 as integer) cls, cast(1.0 / (1.0 + exp(-logit)) >= 0.6 as integer) fg from sem")
def harden(spark, sf_dir):
    s = _sem(spark, sf_dir)
    return s.select("slice", "y", "x", image.harden(F.col("p")).alias("cls"), image.harden(image.probability(F.array("logit")), 0.6).alias("fg"))


@registry.query("softmax", f"with {_PIXELS}, {_SEM} select slice, y, x, round(exp(p[1]) / (exp(p[1]) + exp(p[2]) + exp(p[3])), 9) p0, round(exp(p[3]) / (exp(p[1]) + exp(p[2]) + exp(p[3])), 9) p2 from sem")
def softmax(spark, sf_dir):
    s = _sem(spark, sf_dir).withColumn("q", image.probability(F.col("p")))
    return s.select("slice", "y", "x", F.round(F.col("q")[0], 9).alias("p0"), F.round(F.col("q")[2], 9).alias("p2"))


@registry.query("uncertain_points", f"""with {_PIXELS}, {_SEM}, u as (select slice, y, x, list_sort(p, 'desc')[2] - list_sort(p, 'desc')[1] u from sem),
r as (select *, row_number() over (partition by slice order by u desc, y, x) k from u) select slice, y, x, round(u, 9) u from r where k <= 50""")
def uncertain_points(spark, sf_dir):
    """The 50 least certain pixels of each slice."""
    u = _sem(spark, sf_dir).withColumn("u", image.uncertainty(F.col("p")))
    return image.least_certain(u, ["slice"], "u", 50, ["y", "x"]).select("slice", "y", "x", F.round("u", 9).alias("u"))


@registry.query("nms_peaks", f"""with {_DENSE}, a as (select *, max(v) over (partition by slice, y order by x range between 3 preceding and 3 following) m from dense),
b as (select *, max(m) over (partition by slice, x order by y range between 3 preceding and 3 following) t from a) select slice, y, x, v from b where v = t and v > 10""")
def nms_peaks(spark, sf_dir):
    return image.peaks(dense(spark, sf_dir), "v", 10.0, 7).select("slice", "y", "x", "v")


@registry.query("boundary", f"""with {_DENSE},
e as (select slice, y, x, case when
  coalesce(max(label) over (partition by slice, y order by x range between 1 preceding and 1 preceding), label) <> coalesce(max(label) over (partition by slice, y order by x range between 1 following and 1 following), label)
  or coalesce(max(label) over (partition by slice, x order by y range between 1 preceding and 1 preceding), label) <> coalesce(max(label) over (partition by slice, x order by y range between 1 following and 1 following), label)
  then 1 else 0 end edge from dense),
a as (select *, max(edge) over (partition by slice, y order by x range between 1 preceding and 1 following) m from e)
select slice, y, x, max(m) over (partition by slice, x order by y range between 1 preceding and 1 following) bd from a""")
def boundary(spark, sf_dir):
    return image.boundary(dense(spark, sf_dir), "label")


@registry.query("offsets", f"""with {_DENSE}, c as (select slice, label, avg(y) cy, avg(x) cx from dense where label > 0 group by 1, 2)
select d.slice, y, x, round(cy - y, 9) off_y, round(cx - x, 9) off_x from dense d join c on c.slice = d.slice and c.label = d.label""")
def offsets(spark, sf_dir):
    got = image.offsets(dense(spark, sf_dir).filter("label > 0"), "label")
    return got.select("slice", "y", "x", F.round("off_y", 9).alias("off_y"), F.round("off_x", 9).alias("off_x"))


@registry.query("heatmap", f"""with {_DENSE}, c as (select distinct slice, cast(floor(cy) as integer) y, cast(floor(cx) as integer) x from (select slice, label, avg(y) cy, avg(x) cx from dense where label > 0 group by 1, 2)),
w as (select i, exp(-(i * i) / 72.0) g from (select unnest(range(-24, 25)) i)), n as (select sum(g) t from w),
b as (select slice, d.y, d.x, c.y cy, c.x cx from dense d join c using (slice)),
h as (select b.slice, b.y, b.x, sum(wy.g * wx.g / (t * t)) v from b join w wy on wy.i = b.y - cy join w wx on wx.i = b.x - cx, n group by 1, 2, 3)
select slice, y, x, round(v / max(v) over (partition by slice), 9) heat from h""")
def heatmap(spark, sf_dir):
    centers = image.region_centers(dense(spark, sf_dir).filter("label > 0"), "label")
    return image.heatmap(centers, 97, 64).select("slice", "y", "x", F.round("heat", 9).alias("heat"))


@registry.query("nearest_center", """with c as (select c_nationkey, c_custkey % 25 center, avg(c_acctbal) cy, avg(c_custkey) / 10 cx from customer group by 1, 2),
d as (select k.c_custkey, center, row_number() over (partition by k.c_custkey order by sqrt(pow(cy - c_acctbal, 2) + pow(cx - c_custkey, 2)), center) r from customer k join c using (c_nationkey)
  where sqrt(pow(cy - c_acctbal, 2) + pow(cx - c_custkey, 2)) < 100000)
select c_custkey, center from d where r = 1""")
def nearest_center(spark, sf_dir):
    """On a grid with cells of 4,000."""
    cu = table(spark, sf_dir, "customer")
    centers = cu.groupBy("c_nationkey", (F.col("c_custkey") % 25).alias("center")).agg(F.avg("c_acctbal").alias("cy"), (F.avg("c_custkey") / 10).alias("cx"))
    points = cu.select("c_nationkey", "c_custkey", F.col("c_acctbal").alias("py"), F.col("c_custkey").cast("double").alias("px"))
    return image.nearest_center(points, centers, ["c_nationkey"], cell=4000.0).select("c_custkey", "center")


_MERGE = """s as (select slice, y, x, pan // 1000 sem, case when pan // 1000 = 3 then 0 else (y // 16) * 8 + x // 16 + 1 end ins from px)"""


@registry.query("panoptic_merge", f"""with {_PIXELS}, {_MERGE}, v as (select slice, ins, sem, count(*) n from s where sem in (1, 2) and ins > 0 group by 1, 2, 3),
w as (select *, row_number() over (partition by slice, ins order by n desc, sem) r from v), won as (select slice, ins, sem cls from w where r = 1),
ids as (select slice, ins, cls * 1000 + row_number() over (partition by slice, cls order by ins) pan from won),
st as (select slice, sem, count(*) n from s where sem not in (1, 2) and ins <= 0 group by 1, 2)
select s.slice, y, x, cast(case when s.sem in (1, 2) and s.ins > 0 then ids.pan when s.sem not in (1, 2) and s.ins <= 0 and st.n >= 64 then s.sem * 1000 else -1 end as bigint) pan
from s left join ids on ids.slice = s.slice and ids.ins = s.ins left join st on st.slice = s.slice and st.sem = s.sem""")
def panoptic_merge(spark, sf_dir):
    px = pixels(spark, sf_dir).withColumn("sem", image.class_of("pan", DIVISOR))
    ins = F.when(F.col("sem") == 3, 0).otherwise(F.floor(F.col("y") / 16) * 8 + F.floor(F.col("x") / 16) + 1)
    return image.panoptic_merge(px.withColumn("ins", ins), DIVISOR, [1, 2], 64, -1).select("slice", "y", "x", F.col("pan").cast("bigint").alias("pan"))


@registry.query("image_components", f"""with recursive {_PIXELS},
q as (select slice, y, x, pan // 1000 * 100 + pan % 1000 // 8 lab from px),
e as (select a.slice, a.y y1, a.x x1, b.y y2, b.x x2 from q a join q b on a.slice = b.slice and a.lab = b.lab and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1),
reach(slice, y, x, y2, x2) as (select slice, y, x, y, x from q union select r.slice, r.y, r.x, e.y2, e.x2 from reach r join e on e.slice = r.slice and e.y1 = r.y2 and e.x1 = r.x2),
root as (select slice, y, x, min(y2 * 100000 + x2) root from reach group by 1, 2, 3)
select slice, root, cast(count(*) as bigint) area from root group by 1, 2""")
def image_components(spark, sf_dir):
    """Area of each 8-connected region of equal label, with its first pixel."""
    q = pixels(spark, sf_dir).select("slice", "y", "x", (image.class_of("pan", DIVISOR) * 100 + F.floor((F.col("pan") % DIVISOR) / 8)).alias("lab"))
    got = image.image_components(q, "lab", Scratch(spark, "image"))
    return got.groupBy("slice", "component").agg(F.min(F.col("y").cast("bigint") * 100000 + F.col("x")).alias("root"), F.count(F.lit(1)).alias("area")).select("slice", "root", "area")


@registry.query("watershed")
def contour_watershed(spark, sf_dir):
    """Instances of a volume of 7 slices; brightness from the quantity, contours from the price."""
    li = table(spark, sf_dir, "lineitem")
    v = li.groupBy(F.col("l_linenumber").alias("z"), (F.col("l_suppkey") % 97).cast("int").alias("y"), (F.col("l_partkey") % 64).cast("int").alias("x")).agg((F.max("l_quantity") * 5).cast("int").alias("sem"), (F.min("l_quantity") * 5).cast("int").alias("bd"))
    return watershed.contour_watershed(v, 0.85, 0.8, 0.5, seed_size=2, min_size=8)


@registry.query("orthoplane_sum", f"with {_PIXELS}, {_SEM} select y, x, cast(sum(cast(floor(85 * p[1]) as integer)) as bigint) q from sem group by 1, 2")
def orthoplane_sum(spark, sf_dir):
    """Quantised probabilities added up over the stacks (coefficient 255 // 3)."""
    return volume.quantised_sum(_sem(spark, sf_dir).withColumn("p0", F.col("p")[0]), ["y", "x"], "p0", 3, "q")


@registry.query("pad", f"with {_DENSE} select slice, y, x, label from dense union all select s.slice, y, x, 0 from (select distinct slice from dense) s, (select cast(unnest(range(0, 112)) as integer) y) y, (select cast(unnest(range(0, 64)) as integer) x) x where y >= 97")
def pad(spark, sf_dir):
    return image.pad(dense(spark, sf_dir), 97, 64, 16, "label")


@registry.query("upsample", f"with {_PIXELS} select slice, y * 2 + a y, x * 2 + b x, pan from px, (select unnest([0, 1]) a), (select unnest([0, 1]) b)")
def upsample(spark, sf_dir):
    return image.upsample(pixels(spark, sf_dir), 2)


@registry.query("downsample", f"""with {_DENSE}, g as (select slice, unnest(range(0, 49)) y from (select distinct slice from dense)), g2 as (select slice, y, unnest(range(0, 32)) x from g),
t as (select *, (y + 0.5::double) * (97.0::double / 49) - 0.5 fy, (x + 0.5::double) * 2 - 0.5 fx from g2),
u as (select slice, y, x, fy - floor(fy) wy, fx - floor(fx) wx, greatest(0, least(96, floor(fy))) a, greatest(0, least(96, floor(fy) + 1)) b, greatest(0, least(63, floor(fx))) c, greatest(0, least(63, floor(fx) + 1)) d from t)
select u.slice, cast(u.y as integer) y, cast(u.x as integer) x, round(p.v * (1 - wy) * (1 - wx) + q.v * (1 - wy) * wx + r.v * wy * (1 - wx) + s.v * wy * wx, 6) v from u
join dense p on p.slice = u.slice and p.y = a and p.x = c join dense q on q.slice = u.slice and q.y = a and q.x = d
join dense r on r.slice = u.slice and r.y = b and r.x = c join dense s on s.slice = u.slice and s.y = b and s.x = d""")
def downsample(spark, sf_dir):
    return image.downsample(dense(spark, sf_dir), 97, 64, 2, "v").withColumn("v", F.round("v", 6))


@registry.query("point_sample", f"""with {_DENSE}, pt as (select e_id point, 1 + e_id % 7 slice, (e_id % 101) / 100.0::double u, (e_id % 89) / 88.0::double v from (select event_id e_id from events)),
t as (select *, v * 97 - 0.5 fy, u * 64 - 0.5 fx from pt),
w as (select point, slice, floor(fy) + a y, floor(fx) + b x, (case when a = 0 then 1 - (fy - floor(fy)) else fy - floor(fy) end) * (case when b = 0 then 1 - (fx - floor(fx)) else fx - floor(fx) end) k from t, (select unnest([0, 1]) a), (select unnest([0, 1]) b))
select point, round(sum(k * coalesce(d.v, 0)), 6) sample from w left join dense d on d.slice = w.slice and d.y = w.y and d.x = w.x group by 1""")
def point_sample(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("point"), (1 + F.col("event_id") % 7).alias("slice"), ((F.col("event_id") % 101) / 100.0).alias("u"), ((F.col("event_id") % 89) / 88.0).alias("v"))
    src = dense(spark, sf_dir).withColumnRenamed("v", "sample")
    return image.point_sample(src, e, 97, 64, "sample").select("point", F.round("sample", 6).alias("sample"))


@registry.query("dense_iou", f"""with {_DENSE}, q as (select slice, label gt, cast(v as integer) % 5 pred from dense), s as (select slice, gt, pred, unnest(list_distinct([gt, pred])) class from q)
select slice, class, round((count(*) filter (gt = pred) + 0.00001) / (count(*) + 0.00001), 9) iou from s group by 1, 2""")
def dense_iou(spark, sf_dir):
    q = dense(spark, sf_dir).select("slice", F.col("label").alias("gt"), (F.col("v").cast("int") % 5).alias("pred"))
    return registry_of.measure("dense_iou", q, ["slice"], "gt", "pred").select("slice", "class", F.round("iou", 9).alias("iou"))


# --- slice streams: the events of a user in order


@registry.query("median_stack", """with o as (select *, row_number() over w k, count(*) over (partition by user_id) n, lag(value) over w a, lead(value) over w b from events window w as (partition by user_id order by ts, event_id))
select user_id, event_id, round(case when k = 1 or k = n then value else list_sort([a, value, b])[2] end, 9) median from o""")
def median_stack(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return median.sliding_median(e, ["user_id"], ["ts", "event_id"], "value", 3).select("user_id", "event_id", F.round("median", 9).alias("median"))


@registry.query("median_recursive", """with recursive o as (select user_id, event_id, value, row_number() over w k, count(*) over (partition by user_id) n, lead(value) over w b from events window w as (partition by user_id order by ts, event_id)),
r as (select user_id, event_id, k, n, value m from o where k = 1
  union all select o.user_id, o.event_id, o.k, o.n, case when o.k = o.n then o.value else list_sort([r.m, o.value, o.b])[2] end from r join o on o.user_id = r.user_id and o.k = r.k + 1)
select user_id, event_id, round(m, 9) median from r""")
def median_recursive(spark, sf_dir):
    """The window of three with medians written back."""
    return median.recursive_median(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 3).select("user_id", "event_id", F.round("median", 9).alias("median"))


@registry.query("ema", """with o as (select *, row_number() over (partition by user_id order by ts, event_id) i, count(*) over (partition by user_id) n from events)
select user_id, max(n) n, round(sum(value * 0.02 * pow(0.98, n - i)) / (1 - pow(0.98, max(n))), 6) ema from o group by 1""")
def ema(spark, sf_dir):
    return metrics.ema(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", "n", F.round("ema", 6).alias("ema"))


@registry.query("meters", "select event_type, count(*) n, round(avg(value), 6) mean, round(sum(value), 4) total from events group by 1")
def meters(spark, sf_dir):
    got = metrics.averages(table(spark, sf_dir, "events"), ["event_type"], "value")
    return got.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("total", 4).alias("total"))


_LOSS = "l as (select event_type, event_id, value / 100 - 0.5 logit, event_id % 2 t from events), b as (select *, greatest(logit, 0) - logit * t + ln(1 + exp(-abs(logit))) loss from l)"


@registry.query("topk_loss", f"""with {_LOSS}, r as (select *, row_number() over (partition by event_type order by loss desc, event_id) k, count(*) over (partition by event_type) n from b)
select event_type, round(avg(loss) filter (k <= floor(n * 0.2)), 6) loss from r group by 1""")
def topk_loss(spark, sf_dir):
    """Binary cross entropy, mean of the hardest fifth."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", metrics.bce(F.col("value") / 100 - 0.5, (F.col("event_id") % 2).cast("double")).alias("loss"))
    return metrics.hardest_mean(e, ["event_type"], "loss").select("event_type", F.round("loss", 6).alias("loss"))


@registry.query("point_loss", f"with {_LOSS} select event_type, round(avg(loss), 6) loss from b group by 1")
def point_loss(spark, sf_dir):
    """Binary cross entropy at points, each event one."""
    e = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 100 - 0.5).alias("logit"), (F.col("event_id") % 2).alias("target"))
    return metrics.point_loss(e, ["event_type"], "logit", "target").withColumn("loss", F.round("loss", 6))


@registry.query("augmented", f"""with {_DENSE}, f as (select slice, x y, 96 - y x, v from dense where slice % 2 = 0 union all select slice, y, x, v from dense where slice % 2 = 1),
b as (select slice, y, x, round(greatest(0, least(255, (v - 127.5) * 1.5 + 127.5 + 25.5)), 6) v from f) select slice, cast(y - 8 as integer) y, cast(x - 8 as integer) x, v from b where y >= 8 and y < 56 and x >= 8 and x < 56""")
def augmented(spark, sf_dir):
    """Even slices turned by a quarter, contrast and brightness changed, a window cut out."""
    steps = [{"name": "turn", "height": 97, "when": F.col("slice") % 2 == 0}, {"name": "brightness_contrast", "brightness": 0.1, "contrast": 0.5}, {"name": "window", "y": 8, "x": 8, "height": 48, "width": 48}]
    out = registry_of.augment(dense(spark, sf_dir).select("slice", "y", "x", F.col("v").alias("value")), steps)
    return out.select("slice", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.round("value", 6).alias("v"))


@registry.query("panoptic_loss", f"""with {_LOSS}, x as (select event_type, event_id, value / 100 h, (event_id % 10) / 10.0::double g, (event_id % 3) / 3.0::double o, event_id % 2 t, loss from events join b using (event_type, event_id)),
r as (select *, row_number() over (partition by event_type order by loss desc, event_id) k, count(*) over (partition by event_type) n from x),
a as (select event_type, avg(loss) filter (k <= floor(n * 0.2)) ce, avg(pow(h - g, 2)) mse, coalesce(sum(abs(h - o) * t) / nullif(sum(t), 0), 0) l1 from r group by 1)
select event_type, round(mse, 6) mse, round(l1, 6) l1, round(ce + 200 * mse + 0.01 * l1, 4) total from a""")
def panoptic_loss(spark, sf_dir):
    n = lambda k: (F.col("event_id") % k).cast("double")
    e = table(spark, sf_dir, "events").select("event_type", "event_id", (F.col("value") / 100).alias("h"), (n(10) / 10).alias("g"), (n(3) / 3).alias("o"), n(2).alias("t"), metrics.bce(F.col("value") / 100 - 0.5, n(2)).alias("ce"))
    ce = metrics.hardest_mean(e, ["event_type"], "ce")
    rest = e.groupBy("event_type").agg(metrics.squared_error("h", "g").alias("mse"), metrics.masked_l1(["h"], ["o"], "t").alias("l1"))
    out = rest.join(ce, "event_type").withColumn("total", metrics.panoptic_loss(F.col("ce"), F.col("mse"), F.col("l1")))
    return out.select("event_type", F.round("mse", 6).alias("mse"), F.round("l1", 6).alias("l1"), F.round("total", 4).alias("total"))


_LABELS = f"{_DENSE}, q as (select slice, y, x, label a, cast(v as integer) % 5 b from dense)"


def _labels(spark, sf_dir):
    return dense(spark, sf_dir).select("slice", "y", "x", F.col("label").alias("a"), (F.col("v").cast("int") % 5).alias("b"))


@registry.query("mask_overlaps", f"""with {_LABELS}, n as (select slice, a, count(*) n from q where a > 0 group by 1, 2), m as (select slice, b, count(*) n from q where b > 0 group by 1, 2),
i as (select slice, a, b, count(*) i from q where a > 0 and b > 0 group by 1, 2, 3)
select i.slice, i.a, i.b, i inter, round(i / cast(n.n + m.n - i as double), 9) iou, round(i / cast(m.n as double), 9) ioa from i join n on n.slice = i.slice and n.a = i.a join m on m.slice = i.slice and m.b = i.b""")
def mask_overlaps(spark, sf_dir):
    got = metrics.mask_overlaps(_labels(spark, sf_dir), ["slice"], "a", "b")
    return got.withColumn("iou", F.round("iou", 9)).withColumn("ioa", F.round("ioa", 9))


@registry.query("dense_scores")
def dense_scores(spark, sf_dir):
    """Scores of one dense label image against another, at an IoU of 0.1."""
    return metrics.dense_scores(_labels(spark, sf_dir), ["slice"], "a", "b", 0.1)


@registry.query("metric_history", """with e as (select cast(ts as date) epoch, event_type metric, cast(user_id % 5 as varchar) class, value from events),
c as (select epoch, metric, class, avg(value) a, count(value) n from e group by 1, 2, 3)
select cast(epoch as varchar) epoch, metric, class, round(a, 6) average, n count from c union all select cast(epoch as varchar), metric, null, round(avg(a), 6), cast(sum(n) as bigint) from c group by 1, 2""")
def metric_history(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("epoch"), F.col("event_type").alias("metric"), (F.col("user_id") % 5).alias("k"), "value")
    return metrics.history(e, "epoch", "metric", "k", "value").withColumn("average", F.round("average", 6))


@registry.query("normalise", f"with {_PIXELS}, t as (select slice, max(pan) m from px group by 1) select px.slice, y, x, cast(floor(pan / cast(m as double) * 255) as integer) v from px join t on t.slice = px.slice")
def normalise(spark, sf_dir):
    px = pixels(spark, sf_dir).select("slice", "y", "x", F.col("pan").cast("double").alias("v"))
    return arrays.normalised(px, ["slice"], "v").select("slice", "y", "x", "v")


@registry.query("contour_loss", f"""with {_LOSS}, r as (select *, row_number() over (partition by event_type order by loss desc, event_id) k, count(*) over (partition by event_type) n from b)
select event_type, round(avg(loss) filter (k <= floor(n * 0.15)) + avg(loss), 6) total from r group by 1""")
def contour_loss(spark, sf_dir):
    """Hardest 15 % of one loss, all of the other."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", metrics.bce(F.col("value") / 100 - 0.5, (F.col("event_id") % 2).cast("double")).alias("loss"))
    hard = metrics.hardest_mean(e, ["event_type"], "loss", 0.15)
    every = metrics.hardest_mean(e, ["event_type"], "loss", 1.0).withColumnRenamed("loss", "other")
    return hard.join(every, "event_type").select("event_type", F.round(metrics.contour_loss(F.col("loss"), F.col("other")), 6).alias("total"))
