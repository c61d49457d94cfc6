"""The registered queries of the subpackage, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlattice.llm import chunking, components, crosssplit, mixing, neardup, reading, tokens
from spanlattice.llm.images import extent
from spanlattice.queries import Registry
from spanlattice.session import table

registry = Registry()

# 1: groups of matched detections

_GROUPS = """
with recursive t as (select node1, node2, iou, list_filter(cluster, lambda x: x is not null) c from cluster_graph),
star as (select coalesce(node1, c[1]) u, unnest(c) v from t
  union all select node1, node2 from t where iou > 0.75 and iou <= 1 and not isnan(iou)),
edges as (select distinct u, v from (select u, v from star union all select v, u from star) where u is not null and v is not null and u <> v),
nodes as (select distinct node from (select node1 node from t union all select node2 from t union all select unnest(c) from t) where node is not null),
reach(node, other) as (select node, node from nodes union select r.node, e.v from reach r join edges e on e.u = r.other),
grouped as (select node, min(other) group_node from reach group by 1)
"""


@registry.query("p1_found", _GROUPS + "select * from grouped")
def p1_found(spark, sf_dir):
    return components.groups(table(spark, sf_dir, "cluster_graph"), "node1", "node2", "iou", "cluster")


@registry.query("p1_spread", _GROUPS + "select * from grouped")
def p1_spread(spark, sf_dir):
    """As p1_found, with joins spread whatever their size."""
    return components.groups(table(spark, sf_dir, "cluster_graph"), "node1", "node2", "iou", "cluster", plain_rows=0)


@registry.query("p1_sizes", _GROUPS + "select size, cast(count(*) as bigint) n_groups from (select count(*) size from grouped group by group_node) group by 1")
def p1_sizes(spark, sf_dir):
    """How many groups there are of each size."""
    return p1_found(spark, sf_dir).groupBy("group_node").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n_groups"))


# 2: the same or almost the same images in evaluation and training directories

# grey levels of readable images that are not blank, one row each: from the hexadecimal form of the bytes
_LEVELS = """
raw as (select distinct patch_id, y1 - y0 h, x1 - x0 w, dtype, hex(image) x from image_patch
  where y1 > y0 and x1 > x0 and octet_length(image) = (y1 - y0) * (x1 - x0) * case dtype when 'uint8' then 1 when 'uint16' then 2 end),
lv as (select patch_id, h, w, case when dtype = 'uint8' then list_transform(range(h * w), lambda i: cast('0x' || substr(x, 2 * i + 1, 2) as integer))
  else list_transform(range(h * w), lambda i: cast('0x' || substr(x, 4 * i + 3, 2) || substr(x, 4 * i + 1, 2) as integer) // 257) end g from raw),
grey as (select distinct on (patch_id) * from lv where list_max(g) - list_min(g) > 3)"""
_CLEAN = "case when starts_with({0}, '/') then '/' else '' end || array_to_string(list_filter(string_split({0}, '/'), lambda s: s not in ('', '.')), '/')"
_ROLES = f"""
dirs as (select run_name, true ev, eval_dir d from train_config union all select run_name, false, train_dir from train_config union all select run_name, false, unnest(additional_train_dirs) from train_config),
roles as (select distinct run_name, ev, {_CLEAN.format('d')} d from dirs where d is not null),
paths as (select distinct patch_id, dataset, {_CLEAN.format('file_path')} p from image_patch),
placed as (select distinct run_name, ev, patch_id, dataset from paths join roles on starts_with(p, roles.d || '/'))"""
_CROSS = f"""with {_LEVELS}, {_ROLES},
cand as (select distinct e.run_name, e.dataset, e.patch_id a, t.patch_id b from placed e join placed t on t.run_name = e.run_name and e.ev and not t.ev and e.patch_id <> t.patch_id),
two as (select distinct a, b from cand), met as (select a, b, unnest(x.g) u, unnest(y.g) v from two join grey x on x.patch_id = a join grey y on y.patch_id = b where x.h = y.h and x.w = y.w),
ok as (select a, b from met group by a, b having 100 * count(*) filter (abs(u - v) <= 3) >= 95 * count(*)),
found as (select distinct run_name, dataset, least(a, b) patch_id1, greatest(a, b) patch_id2 from cand join ok using (a, b))"""


@registry.query("p2_found", _CROSS + " select * from found")
def p2_found(spark, sf_dir):
    return crosssplit.cross_split(table(spark, sf_dir, "image_patch"), table(spark, sf_dir, "train_config"))


@registry.query("p2_images", _CROSS + """, cls as (select patch_id, min(patch_id) over (partition by h, w, g) c from grey where patch_id in (select patch_id from placed)),
role as (select distinct run_name, ev, patch_id, dataset, c from placed join cls using (patch_id)),
hit as (select distinct e.run_name, e.dataset, e.patch_id, e.c class_id, t.c tc from role e join role t on t.run_name = e.run_name and e.ev and not t.ev and e.patch_id <> t.patch_id
  left join ok on ok.a = e.patch_id and ok.b = t.patch_id where e.c = t.c or ok.a is not null)
select run_name, dataset, patch_id, class_id, count(*) n_links from hit group by 1, 2, 3, 4""")
def p2_images(spark, sf_dir):
    """Each evaluation image with a counterpart, its class among those of directories, and how many classes of training images it meets."""
    return crosssplit.CrossSplit(table(spark, sf_dir, "image_patch"), table(spark, sf_dir, "train_config")).images()


@registry.query("p2_report", _CROSS + " select run_name, dataset, count(*) n_pairs from found group by 1, 2")
def p2_report(spark, sf_dir):
    """Counts per run and dataset of the evaluation image."""
    return crosssplit.overlap_report(p2_found(spark, sf_dir))


# 3: near-duplicate images

_NEAR = f"""with recursive {_LEVELS},
pos as (select patch_id, g, h, w, unnest(range(h * w)) i from grey where w >= 8), seq as (select distinct patch_id, g[i + 1 : i + 8] q from pos where i % w <= w - 8),
size as (select patch_id, count(*) n from seq group by 1), com as (select a.patch_id a, b.patch_id b, count(*) c from seq a join seq b on a.q = b.q and a.patch_id < b.patch_id group by 1, 2),
pairs as (select a patch_id1, b patch_id2 from com join size x on x.patch_id = a join size y on y.patch_id = b where 10 * c >= 6 * (x.n + y.n - c))"""


@registry.query("p3_found", _NEAR + " select * from pairs")
def p3_found(spark, sf_dir):
    return neardup.NearDuplicates(table(spark, sf_dir, "image_patch")).image_pairs()


@registry.query(
    "p3_groups",
    _NEAR + """, sets as (select patch_id, list(q order by q) s from seq group by 1), cls as (select patch_id, min(patch_id) over (partition by s) class_id from sets),
ends as (select patch_id1 u, patch_id2 v from pairs union all select patch_id2, patch_id1 from pairs), reach(n, o) as (select patch_id, patch_id from size union select r.n, e.v from reach r join ends e on e.u = r.o),
grp as (select n patch_id, min(o) group_id from reach group by 1),
links as (select u patch_id, count(distinct c.class_id) k from ends join cls me on me.patch_id = u join cls c on c.patch_id = v where c.class_id <> me.class_id group by 1)
select cls.patch_id, class_id, coalesce(k, 0) n_links, group_id from cls join grp using (patch_id) left join links using (patch_id)""",
)
def p3_groups(spark, sf_dir):
    """One row per image: its class, the number of similar classes, and its group."""
    return neardup.NearDuplicates(table(spark, sf_dir, "image_patch")).image_groups()


# 5: oversized arrays in pieces


def _pieces(spark, sf_dir, make=chunking.pieces, **how):
    images = make(table(spark, sf_dir, "image_patch"), "image", "patch_id", "image", "dtype", extent("y0", "y1"), extent("x0", "x1"), 512, **how)
    volumes = make(table(spark, sf_dir, "em_volume"), "em", "volume_id", "em", "dtype", F.col("n_slices"), F.try_multiply(F.col("n_rows").cast("bigint"), F.col("n_cols").cast("bigint")), 2048, **how)
    return images.unionAll(volumes)


_PIECES = """with recursive
iraw as (select distinct patch_id id, y1 - y0 n, x1 - x0 w, dtype, hex(image) x from image_patch
  where y1 > y0 and x1 > x0 and octet_length(image) = (y1 - y0) * (x1 - x0) * case dtype when 'uint8' then 1 when 'uint16' then 2 end and (y1 - y0) * (x1 - x0) > 512),
vraw as (select distinct volume_id id, n_slices n, n_rows * n_cols w, dtype, hex(em) x from em_volume
  where n_slices > 0 and n_rows > 0 and n_cols > 0 and octet_length(em) = n_slices * n_rows * n_cols * case dtype when 'uint8' then 1 when 'uint16' then 2 end and n_slices * n_rows * n_cols > 2048),
raw as (select 'image' kind, 512 most, * from iraw union all select 'em', 2048, * from vraw),
px as (select kind, id, n, w, most, z, case when dtype = 'uint8' then cast('0x' || substr(x, 2 * i + 1, 2) as integer) else cast('0x' || substr(x, 4 * i + 3, 2) || substr(x, 4 * i + 1, 2) as integer) // 257 end v
  from (select *, unnest(range(z * w, z * w + w)) i from (select *, unnest(range(n)) z from raw))),
still as (select kind, id, z from px group by kind, id, z having max(v) - min(v) <= 3),
bound as (select kind, id, z from still where z > 0 union select s.kind, s.id, s.z + 1 from still s),
item as (select distinct kind, id, n, most // w fit from raw),
nat as (select kind, id, list(z) cuts from bound group by 1, 2),
cut as (select i.*, coalesce(nat.cuts, []) cuts from item i left join nat using (kind, id)),
piece(kind, id, n, fit, cuts, k, a, b) as (
  select kind, id, n, fit, cuts, 0, 0, case when n <= fit then n else coalesce(list_max(list_filter(cuts, lambda z: z >= 3 and z <= fit and z < n)), fit) end from cut
  union all
  select kind, id, n, fit, cuts, k + 1, b - 2, case when n - (b - 2) <= fit then n else coalesce(list_max(list_filter(cuts, lambda z: z >= b + 1 and z <= b - 2 + fit and z < n)), b - 2 + fit) end from piece where b < n)
"""


@registry.query("p5_found", _PIECES + " select kind item_kind, id item_id, cast(k as integer) piece_no, cast(a as integer) first_line, cast(b as integer) end_line from piece")
def p5_found(spark, sf_dir):
    return _pieces(spark, sf_dir)


@registry.query("p5_landmarks")
def p5_landmarks(spark, sf_dir):
    """Pieces whose cuts follow rolling-hash landmarks, so that edits alter neighbouring pieces only."""
    return _pieces(spark, sf_dir, landmark_bits=3)


@registry.query("p5_edits")
def p5_edits(spark, sf_dir):
    """What a line put into the middle of each item does to its pieces, with landmarks and without (the rule of p5_found)."""
    sums = [F.count(F.lit(1)).alias("n_items"), *[F.sum(c).alias(c) for c in ("n_after", "n_altered")], F.max("n_altered").alias("most_altered")]
    each = [_pieces(spark, sf_dir, chunking.edited_pieces, landmark_bits=bits).withColumn("landmarks", F.lit(bits is not None)) for bits in (3, None)]
    return each[0].unionAll(each[1]).groupBy("item_kind", "landmarks").agg(*sums)


# 6: token ids


@registry.query("p6_ids")
def p6_ids(spark, sf_dir):
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text", tokens.vocabulary())


@registry.query(
    "p6_round_trip",
    "select doc_id, text, cast(coalesce(strlen(text), 0) as integer) n_bytes from (select doc_id, coalesce(text, '') as text from documents)",
)
def p6_round_trip(spark, sf_dir):
    """Texts decoded from their ids, with the number of bytes that the last token's offset gives."""
    encoded = tokens.encode_with_offsets(table(spark, sf_dir, "documents"), "doc_id", "text", tokens.vocabulary())
    back = tokens.decode(encoded, "doc_id", "ids", tokens.vocabulary(), also=["byte_to"])
    return back.select("doc_id", "text", F.coalesce(F.try_element_at("byte_to", F.lit(-1)), F.lit(0)).alias("n_bytes"))


# 7: a mix of sources


def _mix(spark, sf_dir):
    return mixing.Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"), tokens.vocabulary())


@registry.query("p7_mix")
def p7_mix(spark, sf_dir):
    return _mix(spark, sf_dir).selection()


@registry.query("p7_shares")
def p7_shares(spark, sf_dir):
    return _mix(spark, sf_dir).shares()


@registry.query(
    "p7_plan",
    """with t as (select distinct lower(trim(source)) source, target_share, coalesce(max_repeats, 1) max_repeats from mix_target where source is not null),
tt as (select source, sum(target_share) target_share, min(max_repeats) max_repeats from t group by 1),
d as (select doc_id, lower(trim(source)) source, length(text) n, case when bitext_id is not null and pair_seq is not null then bitext_id || '|' || pair_seq || '|' || text else '#' || doc_id end same from documents where doc_id is not null and length(text) > 0 and source is not null),
once as (select arg_min(source, doc_id) source, arg_min(n, doc_id) n from d group by same),
z as (select source, count(*) n_docs, cast(sum(n) as bigint) tokens, sum(cast(n as double) * n) squares from once group by 1),
j as (select tt.*, coalesce(n_docs, 0) n_docs, coalesce(tokens, 0) tokens, coalesce(squares, 0) squares, case when target_share > 0 and not isnan(target_share) and max_repeats >= 1 and tokens > 0 then target_share end u from tt left join z using (source)),
p as (select min(max_repeats * tokens / u) per from j), r as (select *, case when u is null then 0 else least(u * per / tokens, max_repeats) end rate from j, p),
f as (select *, floor(rate + 1e-12) whole, greatest(rate - floor(rate + 1e-12), 0) fraction from r)
select source, target_share, max_repeats, n_docs, tokens source_tokens, round(rate, 9) rate, cast(whole as integer) whole_copies, round(fraction, 9) fraction, round(rate * tokens, 3) expected_tokens, round(sqrt(fraction * (1 - fraction) * squares), 3) tokens_sd,
  round(greatest(coalesce(u * per, 0) - rate * tokens, 0), 3) short_tokens from f""",
)
def p7_plan(spark, sf_dir):
    """Rates, expected sizes and their standard deviation, with sizes in code points so that SQL can say the same."""
    plan = mixing.Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"), "", characters=True).plan()
    digits = {"rate": 9, "fraction": 9, "expected_tokens": 3, "tokens_sd": 3, "short_tokens": 3}
    return plan.select(*[F.round(c, digits[c]).alias(c) if c in digits else c for c in plan.columns])


# 8: reading levels


def _levels(spark, sf_dir):
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_label"))


@registry.query("p8_found")
def p8_found(spark, sf_dir):
    return _levels(spark, sf_dir).filter("p_demanding > 0.5").select("doc_id")


@registry.query("p8_profile")
def p8_profile(spark, sf_dir):
    """Documents, characters and mean difficulty per source and level."""
    docs = table(spark, sf_dir, "documents").select("doc_id", mixing.source_name(F.col("source")).alias("source"), "n_chars")
    got = _levels(spark, sf_dir).join(docs, "doc_id").groupBy("source", "level")
    return got.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.round(F.avg("difficulty"), 6).alias("difficulty"))
