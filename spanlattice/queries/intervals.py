"""Queries on runs, boxes, volumes and tracked objects."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlattice.functions.rle import text_runs, text_starts
from spanlattice.operators import boxes, consensus, graph, metrics, runs, tiles, track
from spanlattice.operators.periods import clean_intervals
from spanlattice.plans.registry import apply_filters
from spanlattice.queries import Registry
from spanlattice.session import Scratch, table
from spanlattice.sources import trackers, volume

registry = Registry()
#: Indices of a data set and class lie apart from those of others.
APART = 1 << 36
#: So do the boxes, with fewer slices than this each.
DEEP = 1 << 20
#: Bucket widths of the interval joins.
WIDTHS = (64, 1 << 14)

# --- shared inputs: points and runs of lineitem, and the tracked objects in normal form

_POINTS = "px as (select distinct l_linenumber % 3 src, l_suppkey % 8 lab, cast(floor(l_orderkey / 4) as bigint) idx from lineitem)"
_LINE_RUNS = f"""{_POINTS},
g as (select *, idx - row_number() over (partition by src, lab order by idx) k from px),
line_runs as (select src, lab, min(idx) s, max(idx) + 1 e from g group by src, lab, k)"""


def line_points(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_linenumber") % 3).alias("src"), (F.col("l_suppkey") % 8).alias("lab"), F.floor(F.col("l_orderkey") / 4).alias("idx"))


def line_length(spark, sf_dir):
    """One more than the greatest index of line_points; 0 without any."""
    last = line_points(spark, sf_dir).agg(F.max("idx")).first()[0]
    return 0 if last is None else last + 1


def line_runs(spark, sf_dir):
    return runs.encode(line_points(spark, sf_dir), ["src", "lab"], "idx")


_OBJECTS = """
iv as (select object_id, s, s + r e from (select object_id, unnest(starts) s, unnest(runs) r from tracked_object) where s is not null and r >= 1),
fa as (select *, max(e) over (partition by object_id order by s, e rows between unbounded preceding and 1 preceding) far from iv),
isl as (select *, sum(case when far is null or s > far then 1 else 0 end) over (partition by object_id order by s, e rows unbounded preceding) k from fa),
own_runs as (select object_id, min(s) s, max(e) e from isl group by object_id, k),
obj as (select object_id, min(t.src) src, min(m.dataset_id) dataset_id, min(m.axis) axis, min(t.class_id) class_id, min(t.label) label,
  min(z1) z1, min(y1) y1, min(x1) x1, max(z2) z2, max(y2) y2, max(x2) x2 from tracked_object t join tracker_meta m on t.src = m.src group by 1),
obj_runs as (select o.object_id, o.src, o.dataset_id, o.axis, o.class_id, r.s, r.e from own_runs r join obj o on o.object_id = r.object_id)"""


def objects(spark, sf_dir):
    """One row for each tracked object that has a source: its source, data set, class, label and box."""
    meta = table(spark, sf_dir, "tracker_meta").select("src", "dataset_id", "axis")
    t = table(spark, sf_dir, "tracked_object").drop("starts", "runs").join(meta, "src")
    low = [F.min(c).alias(c) for c in ("src", "dataset_id", "axis", "class_id", "label", "z1", "y1", "x1")]
    return t.groupBy("object_id").agg(*low, *[F.max(c).alias(c) for c in ("z2", "y2", "x2")])


def own_runs(spark, sf_dir):
    """(object_id, s, e): each object's ranges, disjoint."""
    iv = table(spark, sf_dir, "tracked_object").select("object_id", F.explode(clean_intervals("starts", "runs")).alias("i"))
    return runs.join_ranges(iv.select("object_id", F.col("i.s").alias("s"), F.col("i.e").alias("e")), ["object_id"])


def object_runs(spark, sf_dir):
    o = objects(spark, sf_dir).select("object_id", "src", "dataset_id", "axis", "class_id")
    return own_runs(spark, sf_dir).join(o, "object_id")


def graph_inputs(spark, sf_dir):
    """(nodes, runs) for the graph operators; indices and boxes (along z) of different data sets and classes are set apart."""
    place = (F.col("dataset_id") * 16 + F.col("class_id")).cast("bigint")
    o = objects(spark, sf_dir).withColumnRenamed("object_id", "node").withColumnRenamed("src", "source")
    o = o.withColumn("z1", F.col("z1") + place * DEEP).withColumn("z2", F.col("z2") + place * DEEP)
    at = place * APART
    r = object_runs(spark, sf_dir).select(F.col("object_id").alias("node"), (F.col("s") + at).alias("s"), (F.col("e") + at).alias("e"))
    return o, r


# --- encoding


@registry.query("rle_encode", f"with {_LINE_RUNS} select * from line_runs")
def rle_encode(spark, sf_dir):
    return line_runs(spark, sf_dir)


@registry.query("rle_size", f"with {_LINE_RUNS} select src, lab, cast(sum(e - s) as bigint) area, count(*) n_runs from line_runs group by 1, 2")
def rle_size(spark, sf_dir):
    return line_runs(spark, sf_dir).groupBy("src", "lab").agg(F.sum(F.col("e") - F.col("s")).alias("area"), F.count(F.lit(1)).alias("n_runs"))


@registry.query("rle_decode", f"with {_OBJECTS} select object_id, unnest(range(s, e)) idx from own_runs")
def rle_decode(spark, sf_dir):
    return runs.decode(own_runs(spark, sf_dir), ["object_id"])


_TEXT = "txt as (select object_id, string_agg(s || ' ' || (e - s), ' ' order by s) rle from own_runs group by 1)"


def _texts(spark, sf_dir):
    packed = own_runs(spark, sf_dir).groupBy("object_id").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("r"))
    arrays = packed.select("object_id", F.transform("r", lambda x: x["s"]).alias("starts"), F.transform("r", lambda x: x["e"] - x["s"]).alias("runs"))
    return arrays.select("object_id", trackers.to_text(F.col("starts"), F.col("runs")).alias("rle"))


@registry.query("rle_text", f"with {_OBJECTS}, {_TEXT} select * from txt")
def rle_text(spark, sf_dir):
    return _texts(spark, sf_dir)


@registry.query("rle_text_parse", f"with {_OBJECTS} select object_id, s, e - s r from own_runs")
def rle_text_parse(spark, sf_dir):
    both = F.arrays_zip(text_starts(F.col("rle")).alias("s"), text_runs(F.col("rle")).alias("r"))
    return _texts(spark, sf_dir).select("object_id", F.explode(both).alias("x")).select("object_id", "x.s", "x.r")


# --- range sets


@registry.query("range_join", """with b as (select l_suppkey g, l_orderkey s, l_orderkey + cast(l_quantity as bigint) e from lineitem),
f as (select *, max(e) over (partition by g order by s, e rows between unbounded preceding and 1 preceding) far from b where s < e),
i as (select *, sum(case when far is null or s > far then 1 else 0 end) over (partition by g order by s, e rows unbounded preceding) k from f)
select g, min(s) s, max(e) e from i group by g, k""")
def range_join(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return runs.join_ranges(li.select(F.col("l_suppkey").alias("g"), F.col("l_orderkey").alias("s"), (F.col("l_orderkey") + F.col("l_quantity").cast("bigint")).alias("e")), ["g"])


def _vote_sql(source: str, by: str, votes: int, name: str = "voted") -> str:
    return f"""{name}_ev as (select {by}, s p, 1 d from {source} union all select {by}, e, -1 from {source}),
{name}_h as (select {by}, p, sum(d) d from {name}_ev group by {by}, p),
{name}_v as (select {by}, p s, lead(p) over (partition by {by} order by p) e, sum(d) over (partition by {by} order by p rows unbounded preceding) n from {name}_h),
{name}_m as (select *, case when s = lag(e) over (partition by {by} order by s) then 0 else 1 end b from {name}_v where n >= {votes} and e is not null),
{name}_z as (select *, sum(b) over (partition by {by} order by s rows unbounded preceding) i from {name}_m),
{name} as (select {by}, min(s) s, max(e) e from {name}_z group by {by}, i)"""


@registry.query("range_vote", f"with {_OBJECTS}, {_vote_sql('obj_runs', 'dataset_id, class_id', 2)} select * from voted")
def range_vote(spark, sf_dir):
    """Indices of a data set and class that at least two objects cover."""
    return runs.vote_ranges(object_runs(spark, sf_dir), ["dataset_id", "class_id"], 2)


@registry.query("range_vote_all", f"with {_LINE_RUNS}, {_vote_sql('line_runs', 'lab', 3)} select * from voted")
def range_vote_all(spark, sf_dir):
    """The intersection of the three sources, as the vote of all of them."""
    return runs.vote_ranges(line_runs(spark, sf_dir), ["lab"], 3)


_SPACE = 8_000_000


@registry.query("range_invert", f"""with {_OBJECTS}, {_vote_sql('obj_runs', 'src', 1)},
c as (select src, greatest(s, 0) s, least(e, {_SPACE}) e from voted where s < {_SPACE} and e > 0),
a as (select src, e s, lead(s, 1, {_SPACE}) over (partition by src order by s) e from c
  union all select src, 0, min(s) from c group by 1)
select src, cast(s as bigint) s, cast(e as bigint) e from a where s < e""")
def range_invert(spark, sf_dir):
    """What no object of a source covers."""
    return runs.invert(object_runs(spark, sf_dir), ["src"], _SPACE)


_PAIRS = """sz as (select object_id, sum(e - s) area from own_runs group by 1),
it as (select a.object_id id1, b.object_id id2, sum(least(a.e, b.e) - greatest(a.s, b.s)) i from obj_runs a join obj_runs b
  on a.dataset_id = b.dataset_id and a.class_id = b.class_id and a.src <> b.src and a.object_id < b.object_id and a.s < b.e and b.s < a.e group by 1, 2),
pairs as (select id1, id2, cast(i as bigint) inter, i / cast(x.area + y.area - i as double) iou, i / cast(y.area as double) ioa
  from it join sz x on x.object_id = id1 join sz y on y.object_id = id2)"""


@registry.query("rle_iou_pairs", f"with {_OBJECTS}, {_PAIRS} select id1, id2, inter, round(iou, 9) iou, round(ioa, 9) ioa from pairs")
def rle_iou_pairs(spark, sf_dir):
    """Objects of different sources of a data set and class that share an index."""
    _, r = graph_inputs(spark, sf_dir)
    r = r.join(objects(spark, sf_dir).select(F.col("object_id").alias("node"), "src"), "node")
    a = r.select(F.col("node").alias("id1"), F.col("src").alias("s1"), "s", "e")
    b = r.select(F.col("node").alias("id2"), F.col("src").alias("s2"), "s", "e")
    met = runs.pair_overlaps(a, ["id1", "s1"], b, ["id2", "s2"], on=(F.col("id1") < F.col("id2")) & (F.col("s1") != F.col("s2")), bucket=WIDTHS)
    return met.select("id1", "id2", "inter", F.round("iou", 9).alias("iou"), F.round("ioa", 9).alias("ioa"))


# --- boxes


@registry.query("box_area_union", f"""with {_OBJECTS} select src, class_id, min(z1) z1, min(y1) y1, min(x1) x1, max(z2) z2, max(y2) y2, max(x2) x2,
  cast(sum(cast(z2 - z1 as bigint) * (y2 - y1) * (x2 - x1)) as bigint) areas from obj group by 1, 2""")
def box_area_union(spark, sf_dir):
    o = objects(spark, sf_dir).withColumn("area", boxes.area(boxes.D3))
    return boxes.union_boxes(o, ["src", "class_id"], boxes.D3).join(o.groupBy("src", "class_id").agg(F.sum("area").alias("areas")), ["src", "class_id"])


@registry.query("box_overlap", f"""with {_OBJECTS}, b as (select * from obj where z1 < z2 and y1 < y2 and x1 < x2),
m as (select a.object_id id1, b.object_id id2, cast(least(a.z2, b.z2) - greatest(a.z1, b.z1) as bigint) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) * (least(a.x2, b.x2) - greatest(a.x1, b.x1)) i,
  cast(a.z2 - a.z1 as bigint) * (a.y2 - a.y1) * (a.x2 - a.x1) na, cast(b.z2 - b.z1 as bigint) * (b.y2 - b.y1) * (b.x2 - b.x1) nb
  from b a join b on a.dataset_id = b.dataset_id and a.src <> b.src and a.object_id < b.object_id and a.z1 < b.z2 and b.z1 < a.z2 and a.y1 < b.y2 and b.y1 < a.y2 and a.x1 < b.x2 and b.x1 < a.x2)
select id1, id2, i inter, round(i / cast(na + nb - i as double), 9) iou from m""")
def box_overlap(spark, sf_dir):
    o = objects(spark, sf_dir)
    on = (F.col("a_dataset_id") == F.col("b_dataset_id")) & (F.col("a_src") != F.col("b_src")) & (F.col("a_object_id") < F.col("b_object_id"))
    met = boxes.overlap_join(o, o, on, boxes.D3, cell=32)
    return met.select(F.col("a_object_id").alias("id1"), F.col("b_object_id").alias("id2"), "inter", F.round(boxes.box_iou(boxes.D3), 9).alias("iou"))


@registry.query("filter_objects", f"""with {_OBJECTS}, sz as (select object_id, sum(e - s) area from own_runs group by 1)
select o.object_id, o.src from obj o join sz on sz.object_id = o.object_id where area >= 64 and least(z2 - z1, y2 - y1, x2 - x1) >= 2 and z1 + z2 + y1 + y2 + x1 + x2 is not null""")
def filter_objects(spark, sf_dir):
    """Size and span filters by name, in order."""
    o = objects(spark, sf_dir).withColumnRenamed("object_id", "node").dropna(subset=["z1", "y1", "x1", "z2", "y2", "x2"])
    kept = apply_filters(o, own_runs(spark, sf_dir).withColumnRenamed("object_id", "node"), [{"name": "remove_small_objects", "min_size": 64}, {"name": "remove_pancakes", "min_span": 2}])
    return kept.select(F.col("node").alias("object_id"), "src")


# --- graphs


@registry.query("overlap_graph", f"with {_OBJECTS}, {_PAIRS} select id1 u, id2 v, round(iou, 9) iou, inter overlap from pairs")
def overlap_graph(spark, sf_dir):
    o, r = graph_inputs(spark, sf_dir)
    e = graph.overlap_edges(o, r, None, bucket=WIDTHS)
    return e.select("u", "v", F.round("iou", 9).alias("iou"), "overlap")


_REACH = """reach(node, other) as (select u, u from ends union select r.node, s.v from reach r join ends s on s.u = r.other)"""


_COMPONENTS = f"""with recursive pairs as (select node1 u, node2 v from cluster_graph where node1 is not null and node2 is not null and node1 <> node2 and iou > 0.75),
ends as (select u, v from pairs union select v, u from pairs), {_REACH} select node v, min(other) component from reach group by 1"""


def _matches(spark, sf_dir):
    return table(spark, sf_dir, "cluster_graph").filter("iou > 0.75").select(F.col("node1").alias("u"), F.col("node2").alias("v"))


@registry.query("graph_components", _COMPONENTS)
def graph_components(spark, sf_dir):
    """Components of the measured matches (NaN counts as above every number here)."""
    return graph.components(_matches(spark, sf_dir), Scratch(spark, "components"))


@registry.query("graph_components_rounds", _COMPONENTS)
def graph_components_rounds(spark, sf_dir):
    """The same with tasks that contract a few vertices at a time and joins spread whatever their size, so that the rounds of stars run."""
    return graph.components(_matches(spark, sf_dir), Scratch(spark, "components"), plain_rows=0, united=50)


@registry.query("cluster_graph_edges", f"""with recursive {_OBJECTS}, {_PAIRS},
ends as (select id1 u, id2 v from pairs where iou > 0.5 union select id2, id1 from pairs where iou > 0.5), {_REACH},
mem as (select o.object_id node, coalesce(min(other), o.object_id) c from obj o left join reach on reach.node = o.object_id group by o.object_id),
n as (select c, count(*) k from mem group by 1),
x as (select least(a.c, b.c) c1, greatest(a.c, b.c) c2, iou, inter from pairs join mem a on a.node = id1 join mem b on b.node = id2 where a.c <> b.c),
s as (select c1, c2, sum(iou) / cast(any_value(p.k) * any_value(q.k) as double) iou, sum(inter) / cast(any_value(p.k) * any_value(q.k) as double) overlap
  from x join n p on p.c = c1 join n q on q.c = c2 group by c1, c2)
select c1, c2, round(iou, 6) iou, round(overlap, 6) overlap from s where iou > 0.01 or overlap > 100""")
def cluster_graph_edges(spark, sf_dir):
    """Mean edges between clusters of objects whose IoU is above 0.5."""
    scratch = Scratch(spark, "clusters")
    o, r = graph_inputs(spark, sf_dir)
    e = scratch.keep(graph.overlap_edges(o, r, None, bucket=WIDTHS))
    members = graph.with_components(o.select("node"), e.filter("iou > 0.5"), scratch).select("node", F.col("component").alias("cluster"))
    return graph.cluster_edges(members, e).select("c1", "c2", F.round("iou", 6).alias("iou"), F.round("overlap", 6).alias("overlap"))


@registry.query("consensus")
def consensus_runs(spark, sf_dir):
    """Instances that two of a data set's three trackers agree on. By the runs alone: the stored boxes may be null or disagree with them."""
    o, r = graph_inputs(spark, sf_dir)
    return consensus.Consensus(o, r, 3, votes=2, cluster_iou=0.75, bucket=WIDTHS, screen=False).runs


@registry.query("semantic_consensus", f"with {_OBJECTS}, {_vote_sql('obj_runs', 'src, dataset_id, class_id', 1, 'one')}, {_vote_sql('one', 'dataset_id, class_id', 2)} select * from voted")
def semantic_consensus(spark, sf_dir):
    """Each source of a class as one segment; what at least two sources cover."""
    one = runs.join_ranges(object_runs(spark, sf_dir), ["src", "dataset_id", "class_id"])
    return consensus.semantic_consensus(objects(spark, sf_dir), one, ["dataset_id", "class_id"], 2)[1]


# --- tiles


_STITCH = f"""{_OBJECTS}, {_PAIRS}, ends as (select id1 u, id2 v from pairs union select id2, id1 from pairs), {_REACH},
mem as (select o.object_id node, any_value(o.dataset_id) d, any_value(o.class_id) k, coalesce(min(other), o.object_id) component from obj o left join reach on reach.node = o.object_id group by o.object_id),
all_runs as (select component, any_value(d) over (partition by component) d, s, e from mem join own_runs on object_id = node),
{_vote_sql('all_runs', 'component', 1)}"""


@registry.query("tile_stitch", f"with recursive {_STITCH} select component, cast(count(*) as bigint) n_runs, cast(sum(e - s) as bigint) area from voted group by 1")
def tile_stitch(spark, sf_dir):
    """Objects of different sources that share an index made one: the least object of each, its runs and its size."""
    o, r = graph_inputs(spark, sf_dir)
    got = consensus.Stitch(o, r, dims=boxes.D3, bucket=WIDTHS, screen=False)
    size = got.runs.groupBy("instance").agg(F.count(F.lit(1)).alias("n_runs"), F.sum(F.col("e") - F.col("s")).alias("area"))
    least = got.members.groupBy("instance").agg(F.min("node").alias("component"))
    return size.join(least, "instance").select("component", "n_runs", "area")


_BOXED = f"""{_OBJECTS}, {_PAIRS}, bp as (select id1, id2 from pairs join obj a on a.object_id = id1 join obj b on b.object_id = id2
  where a.z1 < a.z2 and a.y1 < a.y2 and a.x1 < a.x2 and b.z1 < b.z2 and b.y1 < b.y2 and b.x1 < b.x2 and a.z1 < b.z2 and b.z1 < a.z2 and a.y1 < b.y2 and b.y1 < a.y2 and a.x1 < b.x2 and b.x1 < a.x2),
ends as (select id1 u, id2 v from bp union select id2, id1 from bp), {_REACH},
mem as (select o.object_id node, coalesce(min(other), o.object_id) component from obj o left join reach on reach.node = o.object_id group by o.object_id),
all_runs as (select component, (dataset_id * 16 + class_id) * {APART} + s s, (dataset_id * 16 + class_id) * {APART} + e e from mem join obj_runs on object_id = node),
{_vote_sql('all_runs', 'component', 1)},
named as (select component, (select min(label) from obj) + row_number() over (order by component) - 1 instance from (select distinct component from voted))"""


@registry.query("tile_stitch_boxed", f"with recursive {_BOXED} select cast(instance as bigint) instance, s, e from voted join named using (component)")
def tile_stitch_boxed(spark, sf_dir):
    """The same with boxes as screen (objects without a box stand alone), numbered from the least label."""
    o, r = graph_inputs(spark, sf_dir)
    return consensus.Stitch(o, r, dims=boxes.D3, bucket=WIDTHS).runs


@registry.query("semantic_stitch", f"with {_OBJECTS}, one as (select class_id, dataset_id * {APART} + s s, dataset_id * {APART} + e e from obj_runs), {_vote_sql('one', 'class_id', 1)} select * from voted")
def semantic_stitch(spark, sf_dir):
    """All objects of a class as one segment; data sets lie apart."""
    at = F.col("dataset_id") * APART
    r = object_runs(spark, sf_dir).select("class_id", (F.col("s") + at).alias("s"), (F.col("e") + at).alias("e"))
    o = objects(spark, sf_dir).withColumnRenamed("src", "source")
    return consensus.semantic_stitch(o, r, boxes.D3)[1]


@registry.query("relabel", f"""with {_OBJECTS}, m as (select object_id, min(object_id) over (partition by src, class_id, label % 10) keep from obj) select keep, cast(count(*) as bigint) n, cast(sum(e - s) as bigint) area from own_runs r join m on m.object_id = r.object_id group by 1""")
def relabel(spark, sf_dir):
    """Objects of a source merged by a table of old and new labels."""
    names = objects(spark, sf_dir).select("object_id", F.min("object_id").over(W.partitionBy("src", "class_id", F.col("label") % 10)).alias("keep"))
    r = own_runs(spark, sf_dir).join(names, "object_id")
    return r.groupBy("keep").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e") - F.col("s")).alias("area"))


@registry.query("merge_objects", f"""with {_OBJECTS}, m as (select object_id, min(object_id) over (partition by src, class_id, label % 10) keep from obj), kept as (select keep, s, e from own_runs r join m on m.object_id = r.object_id), {_vote_sql('kept', 'keep', 1)} select * from voted""")
def merge_objects(spark, sf_dir):
    """The same with their ranges made one."""
    names = objects(spark, sf_dir).select("object_id", F.min("object_id").over(W.partitionBy("src", "class_id", F.col("label") % 10)).alias("keep"))
    return runs.join_ranges(own_runs(spark, sf_dir).join(names, "object_id"), ["keep"])


_TILES = "tiles as (select unnest(range(0, 400)) tile, unnest(range(0, 400)) * 448 s, unnest(range(0, 400)) * 448 + 512 e)"


@registry.query("tile_clip", f"""with {_LINE_RUNS}, {_TILES}
select lab, src, cast(tile as integer) tile, greatest(r.s, t.s) - t.s s, least(r.e, t.e) - t.s e from line_runs r join tiles t on r.s < t.e and t.s < r.e""")
def tile_clip(spark, sf_dir):
    """Runs cut to windows of 512 that begin every 448 indices, up to the table's last index (the SQL's 400 end at 179,264)."""
    windows = spark.range(-(-line_length(spark, sf_dir) // 448)).select(F.col("id").cast("int").alias("tile"), (F.col("id") * 448).alias("s"), (F.col("id") * 448 + 512).alias("e"))
    return tiles.clip_to_windows(line_runs(spark, sf_dir), windows, ["src", "lab"], bucket=64)


@registry.query("tile_round_trip", f"with {_LINE_RUNS} select * from line_runs where s < 1000000")
def tile_round_trip(spark, sf_dir):
    """Runs of an image 1000 wide, and 1000 high or as high as the table needs, cut to tiles of 300 x 200 and put together again (the SQL stops at 1000 rows)."""
    lay = tiles.layout(spark, max(1000, -(-line_length(spark, sf_dir) // 1000)), 1000, (300, 200), 40)
    r = line_runs(spark, sf_dir)
    back = tiles.to_image(tiles.to_tiles(r, lay, ["src", "lab"], 1000), lay, ["src", "lab"], 1000)
    return runs.join_ranges(back, ["src", "lab"])


@registry.query("chunk_split", f"""with {_LINE_RUNS}, rows as (select src, lab, unnest(range(s // 100, (e - 1) // 100 + 1)) r, s, e from line_runs),
a as (select src, lab, r, greatest(s, r * 100) s, least(e, r * 100 + 100) e from rows),
b as (select src, lab, r, unnest(range((s - r * 100) // 32, (e - 1 - r * 100) // 32 + 1)) cx, s, e from a)
select src, lab, cast((r // 50) // 8 as integer) cz, cast((r % 50) // 16 as integer) cy, cast(cx as integer) cx, greatest(s, r * 100 + cx * 32) s, least(e, r * 100 + cx * 32 + 32) e from b""")
def chunk_split(spark, sf_dir):
    """Runs of a volume with slices of 50 x 100, cut at chunks of 8 x 16 x 32."""
    return volume.chunk_runs(line_runs(spark, sf_dir), ["src", "lab"], (1 << 20, 50, 100), (8, 16, 32))


@registry.query("fill_last_wins", f"with {_OBJECTS} select dataset_id, idx, max(object_id) object_id from (select dataset_id, object_id, unnest(range(s, e)) idx from obj_runs) group by 1, 2")
def fill_last_wins(spark, sf_dir):
    """Every index of a data set with the object painted last."""
    r = object_runs(spark, sf_dir)
    far = r.select((F.col("dataset_id") * APART + F.col("s")).alias("s"), (F.col("dataset_id") * APART + F.col("e")).alias("e"), "object_id", F.col("object_id").alias("order"))
    out = volume.fill_last_wins(far, "object_id", "order")
    return out.select(F.floor(F.col("idx") / APART).cast("int").alias("dataset_id"), F.pmod("idx", F.lit(APART)).alias("idx"), "object_id")


# --- tracking


#: Labels of a class.
LABELS = 10**15


def _slice_objects(spark, sf_dir):
    """Objects of the trackers cut at slices of 16384 indices, each piece with a label of its own."""
    cut = runs.cut_at_edges(object_runs(spark, sf_dir), ["src", "class_id", "object_id"], 1 << 14, "slice")
    packed = cut.groupBy("src", "class_id", "slice", "object_id").agg(F.sort_array(F.collect_list(F.struct((F.col("s") - F.col("slice") * (1 << 14)).alias("s"), (F.col("e") - F.col("s")).alias("r")))).alias("x"))
    label = F.col("class_id") * LABELS + F.col("object_id") * 1024 + F.pmod("slice", F.lit(1024)) + 1  # no two of a slice are equal
    return packed.select("src", "class_id", F.col("slice").cast("int").alias("slice"), label.alias("label"), F.transform("x", lambda v: v["s"]).alias("starts"), F.transform("x", lambda v: v["r"]).alias("runs"))


@registry.query("track_forward")
def track_forward(spark, sf_dir):
    return track.track_forward(_slice_objects(spark, sf_dir), ["src", "class_id"], LABELS).select("src", "class_id", "slice", "label", F.size("starts").alias("n_runs"))


@registry.query("track_backward")
def track_backward(spark, sf_dir):
    scratch = Scratch(spark, "backward")
    ahead = scratch.keep(track.track_forward(_slice_objects(spark, sf_dir), ["src", "class_id"], LABELS))
    return track.track_backward(ahead, ["src", "class_id"], LABELS).select("src", "class_id", "slice", "label", F.size("starts").alias("n_runs"))


_LIFT = f"with {_LINE_RUNS}, pts as (select src, lab, lab slice, unnest(range(s, e)) i from line_runs),"


@registry.query("lift_yz", _LIFT + """ v as (select distinct src, lab, i * 8 + slice i from pts), g2 as (select *, i - row_number() over (partition by src, lab order by i) k from v)
select src, lab as label, min(i) s, max(i) + 1 e from g2 group by src, lab, k""")
def lift_yz(spark, sf_dir):
    """Slices across x of a volume 8 wide, put in the volume."""
    return track.lift(_planes(spark, sf_dir), ["src"], "yz", (1 << 20, 50, 8))


@registry.query("lift_xz", _LIFT + """ v as (select distinct src, lab, (i // 100) * 800 + slice * 100 + i % 100 i from pts), g2 as (select *, i - row_number() over (partition by src, lab order by i) k from v)
select src, lab as label, min(i) s, max(i) + 1 e from g2 group by src, lab, k""")
def lift_xz(spark, sf_dir):
    """Slices across y of a volume 8 high and 100 wide; runs are cut at row ends."""
    return track.lift(_planes(spark, sf_dir), ["src"], "xz", (1 << 20, 8, 100))


def _planes(spark, sf_dir):
    return line_runs(spark, sf_dir).select("src", F.col("lab").alias("slice"), F.col("lab").alias("label"), F.array("s").alias("starts"), F.array(F.col("e") - F.col("s")).alias("runs"))


# --- evaluation


_MATCH = """gt as (select cast(floor(l_orderkey / 4) as bigint) idx, min(l_suppkey % 8) lab from lineitem group by 1),
pr as (select cast(floor(l_orderkey / 4) as bigint) idx, min(case when l_linenumber <= 6 then l_suppkey % 8 end) lab from lineitem group by 1),
ga as (select lab, count(*) n from gt group by lab), pa as (select lab, count(*) n from pr where lab is not null group by lab),
it as (select g.lab gl, p.lab pl, count(*) i from gt g join pr p on g.idx = p.idx group by 1, 2),
pair as (select gl, pl, i / cast(ga.n + pa.n - i as double) iou from it join ga on ga.lab = gl join pa on pa.lab = pl)"""


def _segmentations(spark, sf_dir):
    """Two label lines of lineitem: by all lines of four orders, and without the seventh lines."""
    li = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 4).alias("idx"), (F.col("l_suppkey") % 8).alias("lab"), "l_linenumber")
    both = li.groupBy("idx").agg(F.min("lab").alias("gt"), F.min(F.when(F.col("l_linenumber") <= 6, F.col("lab"))).alias("pred"))
    side = lambda c: runs.encode(both.filter(F.col(c).isNotNull()).select(F.lit(0).alias("k"), F.col(c).cast("bigint").alias(c), "idx"), ["k", c], "idx")
    return side("gt"), side("pred")


@registry.query("match_pairs", f"with {_MATCH} select gl gt, pl pred, round(iou, 9) iou from pair where gl = pl and iou >= 0.5")
def match_pairs(spark, sf_dir):
    """One-to-one matches of IoU 0.5 or more. The best assignment on these data is the identity, which SQL can state."""
    gt, pred = _segmentations(spark, sf_dir)
    got = metrics.match_instances(gt, pred, ["k"], Scratch(spark, "match"), 0.5)
    return got.select(F.col("gt").cast("int").alias("gt"), F.col("pred").cast("int").alias("pred"), F.round("iou", 9).alias("iou"))


@registry.query("evaluate", f"""with {_MATCH}, m as (select * from pair where gl = pl and iou >= 0.5),
t as (select (select count(*) from ga) ng, (select count(*) from pa) np, count(*) n, count(*) filter (iou >= 0.75) hi, sum(iou) si from m),
x as (select cast(n as double) tp, ng - n fn, np - n fp, cast(hi as double) tp75, ng - hi fn75, np - hi fp75, si from t),
s as (select count(*) filter (g.lab is not null and p.lab is not null) i, count(*) u from gt g full join (select * from pr where lab is not null) p on g.idx = p.idx)
select 0 k, round(i / cast(u as double), 9) semantic_iou, round(si / (tp + 0.00001) * tp / (tp + 0.5 * fp + 0.5 * fn), 9) pq,
  round(tp / (tp + fp), 9) precision_50, round(tp / (tp + fn), 9) recall_50, round(tp / (tp + 0.5 * fp + 0.5 * fn), 9) f1_50, round(tp / (tp + fp + fn), 9) ap_50,
  round(tp75 / (tp75 + fp75), 9) precision_75, round(tp75 / (tp75 + fn75), 9) recall_75, round(tp75 / (tp75 + 0.5 * fp75 + 0.5 * fn75), 9) f1_75, round(tp75 / (tp75 + fp75 + fn75), 9) ap_75
from x, s""")
def evaluate(spark, sf_dir):
    gt, pred = _segmentations(spark, sf_dir)
    got = metrics.evaluate(gt, pred, ["k"])
    return got.select("k", *[F.round(c, 9).alias(c) for c in got.columns if c != "k"])


@registry.query("unmatched", f"""with {_MATCH}, m as (select * from pair where gl = pl and iou >= 0.5)
select 'gt' side, lab from ga where lab not in (select gl from m) union all select 'pred', lab from pa where lab not in (select pl from m)""")
def unmatched(spark, sf_dir):
    """Objects without a partner."""
    gt, pred = _segmentations(spark, sf_dir)
    m = metrics.match_instances(gt, pred, ["k"], Scratch(spark, "match"), 0.5)
    lone = lambda df, c: df.select(c).distinct().join(m, c, "left_anti").select(F.lit(c).alias("side"), F.col(c).cast("int").alias("lab"))
    return lone(gt, "gt").unionAll(lone(pred, "pred"))


@registry.query("semantic_iou", f"""with {_OBJECTS}, px as (select distinct dataset_id, class_id, axis, unnest(range(s, e)) idx from obj_runs where axis in ('xy', 'xz')),
n as (select dataset_id, class_id, idx, count(*) c from px group by 1, 2, 3)
select dataset_id, class_id, round(count(*) filter (c = 2) / cast(count(*) as double), 9) iou from n group by 1, 2""")
def semantic_iou(spark, sf_dir):
    """Agreement of the trackers across z and y, for each data set and class."""
    r = object_runs(spark, sf_dir)
    got = metrics.semantic_iou(r.filter("axis = 'xy'"), r.filter("axis = 'xz'"), ["dataset_id", "class_id"], bucket=WIDTHS)
    return got.select("dataset_id", "class_id", F.round("iou", 9).alias("iou"))


@registry.query("tracker_match")
def tracker_match(spark, sf_dir):
    """The best one-to-one assignment of objects across two trackers of each data set and class."""
    r = object_runs(spark, sf_dir)
    side = lambda axis, c: r.filter(F.col("axis") == axis).select("dataset_id", "class_id", F.col("object_id").alias(c), "s", "e")
    return metrics.match_instances(side("xy", "gt"), side("xz", "pred"), ["dataset_id", "class_id"], Scratch(spark, "match"), bucket=WIDTHS)


@registry.query("tracker_json", f"""with {_OBJECTS}, {_TEXT}
select m.class_id, m.label_divisor, m.axis, cast(o.label as varchar) as label, o.src, t.rle from obj o join tracker_meta m on m.src = o.src join txt t on t.object_id = o.object_id""")
def tracker_json(spark, sf_dir):
    """Objects in the form of the JSON documents."""
    meta = table(spark, sf_dir, "tracker_meta").select("src", F.col("class_id"), "label_divisor", "axis")
    o = objects(spark, sf_dir).select("object_id", "src", F.col("label").cast("string").alias("label"))
    return o.join(meta, "src").join(_texts(spark, sf_dir), "object_id").select("class_id", "label_divisor", "axis", "label", "src", "rle")
