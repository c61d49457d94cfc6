"""Queries on names, patches, hashes, weights and directories."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlattice.operators import curate
from spanlattice.queries import Registry
from spanlattice.session import Scratch, table
from spanlattice.sources import tables

registry = Registry()

_NAMES = "nm as (select patch_id, min(regexp_extract(file_path, '([^/]+)$', 1)) as name from image_patch group by 1)"


def names(spark, sf_dir):
    p = table(spark, sf_dir, "image_patch")
    return p.groupBy("patch_id").agg(F.min(F.regexp_extract("file_path", "([^/]+)$", 1)).alias("name"))


@registry.query("name_parse", rf"""with {_NAMES}, m as (select patch_id, regexp_extract(name, '^(.*)-(?:ROI|LOC-2d|LOC)-([a-z0-9]+)_(\d+)_(\d+)-(\d+)_(\d+)-(\d+)', ['d', 'a', 'i', 'y0', 'y1', 'x0', 'x1']) p from nm)
select patch_id, nullif(p.d, '') dataset, nullif(p.a, '') axis, try_cast(p.i as integer) idx, try_cast(p.y0 as integer) y0, try_cast(p.y1 as integer) y1, try_cast(p.x0 as integer) x0, try_cast(p.x1 as integer) x1 from m""")
def name_parse(spark, sf_dir):
    return names(spark, sf_dir).select("patch_id", curate.parse_location(F.col("name")).alias("p")).select("patch_id", "p.*")


@registry.query("dataset_names", f"""with {_NAMES}, d as (select case when contains(name, '-ROI-') then split_part(name, '-ROI-', 1) when contains(name, '-LOC-2d-') then split_part(name, '-LOC-2d-', 1)
  when contains(name, '-LOC-') then split_part(name, '-LOC-', 1) else name end dataset from nm) select dataset, count(*) n from d group by 1""")
def dataset_names(spark, sf_dir):
    return names(spark, sf_dir).groupBy(curate.dataset_name(F.col("name")).alias("dataset")).agg(F.count(F.lit(1)).alias("n"))


@registry.query("patch_grid", """with v as (select volume_id, min(n_slices * 100) h, min(n_rows * n_cols) w from em_volume where n_slices > 0 group by 1),
n as (select *, greatest(1, round_even(h / 256.0::double, 0)) a, greatest(1, round_even(w / 256.0::double, 0)) b from v),
i as (select *, unnest(range(0, cast(a as bigint))) i from n), j as (select *, unnest(range(0, cast(b as bigint))) j from i)
select volume_id, cast(i * 256 as integer) y0, cast(least(i * 256 + 256, h) as integer) y1, cast(j * 256 as integer) x0, cast(least(j * 256 + 256, w) as integer) x1 from j""")
def patch_grid(spark, sf_dir):
    v = table(spark, sf_dir, "em_volume").filter("n_slices > 0").groupBy("volume_id").agg(F.min(F.col("n_slices") * 100).alias("h"), F.min(F.col("n_rows") * F.col("n_cols")).alias("w"))
    return curate.patch_grid(v, "h", "w", 256).drop("h", "w")


@registry.query("flipbooks", """with m as (select src, dataset_id, cast(shape3d[1] as integer) d, src % 5 + 1 idx from tracker_meta)
select src, idx - 2 low, idx + 2 high, cast(idx - 2 + 2 as integer) middle from m where idx - 2 >= 0 and idx + 2 < d""")
def flipbooks(spark, sf_dir):
    """Windows of five slices that lie in the volume, with their middle slice."""
    m = table(spark, sf_dir, "tracker_meta").select("src", F.col("shape3d")[0].alias("d"), (F.col("src") % 5 + 1).alias("idx"))
    w = m.withColumn("w", curate.flipbook_span(F.col("idx"), 5, F.col("d"))).filter("w is not null")
    return w.select("src", "w.low", "w.high", curate.middle_slice(F.col("w.low"), F.col("w.high")).alias("middle"))


@registry.query("volume_slices", """with v as (select dataset_id, any_value(dataset) as name, max(shape3d[1]) d, max(shape3d[2]) h, max(shape3d[3]) w from tracker_meta group by 1),
p as (select *, 1.0 + dataset_id % 3 * 0.2 pz from v), a as (select name, 0 axis, d n from p union all select name, 1, h from p where abs(1.0 - pz) <= 0.25 union all select name, 2, w from p where abs(1.0 - pz) <= 0.25)
select name, axis, cast(unnest(range(0, n - 1, 10)) as integer) idx from a where n > 1""")
def volume_slices(spark, sf_dir):
    """Every tenth slice to export; anisotropic volumes along one axis only."""
    m = table(spark, sf_dir, "tracker_meta").groupBy("dataset_id").agg(F.first("dataset").alias("name"), *[F.max(F.col("shape3d")[k]).alias(c) for k, c in enumerate("dhw")])
    return curate.volume_slices(m.withColumn("px", F.lit(1.0)).withColumn("pz", 1.0 + F.col("dataset_id") % 3 * 0.2), 10)


_HASH = "hs as (select vec_id id, list_reduce(list_transform(embedding[1:32], lambda x: cast(x > 0 as bigint)), lambda a, b: a * 2 + b) h from embeddings)"


def hashes(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), curate.sign_hash(F.col("embedding"), 32).alias("h"))


_CLASSES = "cl as (select h, min(id) id from hs group by 1)"


@registry.query("hash_pairs", f"with {_HASH}, {_CLASSES} select a.id a, b.id b, cast(bit_count(xor(a.h, b.h)) as integer) dist from cl a join cl b on a.id < b.id and bit_count(xor(a.h, b.h)) <= 6")
def hash_pairs(spark, sf_dir):
    """Pairs of classes of equal hashes."""
    return curate.hash_pairs(curate.hash_classes(hashes(spark, sf_dir), "id", "h"), 6, 32)


@registry.query("hash_classes", f"with {_HASH}, {_CLASSES} select hs.id, cl.id class_id from hs join cl using (h)")
def hash_classes(spark, sf_dir):
    return curate.hash_classes(hashes(spark, sf_dir), "id", "h").select("id", "class_id")


#: The signs of all 64 elements, in two halves as DuckDB's bigint is signed; within the distance of the surveyed operator.
_HASH64 = "hs as (select vec_id id, list_reduce(list_transform(embedding[1:32], lambda x: cast(x > 0 as bigint)), lambda a, b: a * 2 + b) h1, list_reduce(list_transform(embedding[33:64], lambda x: cast(x > 0 as bigint)), lambda a, b: a * 2 + b) h2 from embeddings)"
_CLASSES64 = "cl as (select h1, h2, min(id) id from hs group by 1, 2)"
BITS, DISTANCE = 64, 12


def hashes64(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), curate.sign_hash(F.col("embedding"), BITS).alias("h"))


@registry.query("hash_pairs_64", f"""with {_HASH64}, {_CLASSES64}, d as (select a.id a, b.id b, cast(bit_count(xor(a.h1, b.h1)) + bit_count(xor(a.h2, b.h2)) as integer) dist from cl a join cl b on a.id < b.id)
select * from d where dist <= {DISTANCE}""")
def hash_pairs_64(spark, sf_dir):
    """hash_pairs over all elements; hash_pairs itself is held to the first 32 by its SQL."""
    return curate.hash_pairs(curate.hash_classes(hashes64(spark, sf_dir), "id", "h"), DISTANCE, BITS, together=2)


@registry.query("hash_classes_64", f"with {_HASH64}, {_CLASSES64} select hs.id, cl.id class_id from hs join cl using (h1, h2)")
def hash_classes_64(spark, sf_dir):
    """hash_classes over all elements."""
    return curate.hash_classes(hashes64(spark, sf_dir), "id", "h").select("id", "class_id")


_IMAGE_HASH = """raw as (select distinct patch_id id, y1 - y0 h, x1 - x0 w, dtype, hex(image) x from image_patch
  where y1 > y0 and x1 > x0 and octet_length(image) = (y1 - y0) * (x1 - x0) * case dtype when 'uint8' then 1 when 'uint16' then 2 end),
px as (select id, i // w * 8 // h r, i % w * 9 // w c, case when dtype = 'uint8' then cast('0x' || substr(x, 2 * i + 1, 2) as integer) else cast('0x' || substr(x, 4 * i + 3, 2) || substr(x, 4 * i + 1, 2) as integer) end v from (select *, unnest(range(h * w)) i from raw)),
m as (select id, r, c, avg(v) v from px group by 1, 2, 3), b as (select a.id, a.r * 8 + a.c k, cast(b.v > a.v as bigint) bit from m a join m b on a.id = b.id and a.r = b.r and b.c = a.c + 1)
select id, cast(sum(case when k < 32 then bit << (31 - k) else 0 end) as bigint) high, cast(sum(case when k >= 32 then bit << (63 - k) else 0 end) as bigint) low from b group by 1"""


def image_hashes(spark, sf_dir):
    p = table(spark, sf_dir, "image_patch")
    side = lambda a, b: F.col(b).cast("bigint") - F.col(a).cast("bigint")
    means = curate.pooled_means(p, "patch_id", "image", "dtype", side("y0", "y1"), side("x0", "x1"))
    return means.select(F.col("patch_id").alias("id"), curate.difference_hash(F.col("values")).alias("h")).distinct()


@registry.query("image_hash", f"with {_IMAGE_HASH}")
def image_hash(spark, sf_dir):
    """Difference hashes of all readable images, pooled to 8 x 9, in two halves."""
    low = F.col("h").bitwiseAND(0xFFFFFFFF)
    return image_hashes(spark, sf_dir).select("id", F.shiftrightunsigned("h", 32).alias("high"), low.alias("low"))


@registry.query("image_dedup")
def image_dedup(spark, sf_dir):
    """Of the images of a data set whose hashes differ in at most 12 bits only greedy exemplars stay; blank images have equal hashes."""
    scratch = Scratch(spark, "dedup")
    of = table(spark, sf_dir, "image_patch").groupBy(F.col("patch_id").alias("id")).agg(F.min("dataset").alias("dataset"))
    h = scratch.keep(image_hashes(spark, sf_dir).join(of, "id"))
    # data sets are kept apart: a class is one hash in one data set
    classes = h.groupBy("dataset", "h").agg(F.min("id").alias("id"))
    return curate.near_exemplars(classes, DISTANCE, "dataset", scratch)


@registry.query("dedup_greedy")
def dedup_greedy(spark, sf_dir):
    """Greedy exemplars by the distance of hashes of all elements: no two kept ones are close, and every other one is close to a kept one."""
    scratch = Scratch(spark, "dedup")
    classes = scratch.keep(curate.hash_classes(hashes64(spark, sf_dir), "id", "h"))
    return curate.exemplars(classes.filter("id = class_id"), "id", curate.hash_pairs(classes, DISTANCE, BITS, together=2), scratch)


@registry.query("sample_weights", "with c as (select event_type, count(*) n from events group by 1), w as (select *, pow(1.0 / n, 0.3) w from c) select event_type, n, round(w / sum(w) over (), 9) weight from w")
def sample_weights(spark, sf_dir):
    return curate.example_weights(table(spark, sf_dir, "events").select("event_type"), "event_type").withColumn("weight", F.round("weight", 9))


@registry.query("majority_class", """with c as (select user_id, event_type, count(*) n from events group by 1, 2), r as (select *, row_number() over (partition by user_id order by n desc, event_type) k from c) select user_id, event_type from r where k = 1""")
def majority_class(spark, sf_dir):
    return curate.majority(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@registry.query("weighted_sample")
def weighted_sample(spark, sf_dir):
    """A thousand events, each event type with the weight of its rarity."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    w = curate.example_weights(e.select("event_type"), "event_type").withColumn("w", F.col("weight") / F.col("n")).select("event_type", "w")
    return curate.weighted_sample(e.join(w, "event_type"), "event_id", "w", 1000)


@registry.query("sample_per_group")
def sample_per_group(spark, sf_dir):
    """At most 50 events of each user."""
    return curate.sample_per_group(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 50)


@registry.query("quality_filter", "select event_id, event_type, cast(value >= 40 as boolean) good from events")
def quality_filter(spark, sf_dir):
    """What a threshold keeps, without the random share."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return curate.quality_filter(e, F.col("value"), 40.0, "event_id", 0.0).select("event_id", "event_type", F.col("kept").alias("good"))


@registry.query("quality_share", "select event_id, cast(value >= 40 or event_id % 10 < 3 as boolean) kept from events")
def quality_share(spark, sf_dir):
    """Three tenths of what is below the threshold stay, drawn by the id's last digit."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    return curate.quality_filter(e, F.col("value"), 40.0, "event_id", 0.3, draw=(F.col("event_id") % 10) / 10).select("event_id", "kept")


@registry.query("sample_sizes", "select user_id, least(count(*), 50) n from events group by 1")
def sample_sizes(spark, sf_dir):
    """How many events of each user sample_per_group takes, each once."""
    return sample_per_group(spark, sf_dir).groupBy("user_id").agg(F.countDistinct("event_id").alias("n"))


@registry.query("dedup_by_id", f"""with recursive {_HASH64}, {_CLASSES64}, o as (select id, h1, h2, row_number() over (order by id) k from cl),
g(k, kept) as (select cast(0 as bigint), [{{'id': cast(-1 as bigint), 'h1': cast(null as bigint), 'h2': cast(null as bigint)}}]
  union all select o.k, case when len(list_filter(kept, lambda x: bit_count(xor(x.h1, o.h1)) + bit_count(xor(x.h2, o.h2)) <= 20)) > 0 then kept else list_append(kept, {{'id': o.id, 'h1': cast(o.h1 as bigint), 'h2': cast(o.h2 as bigint)}}) end from g join o on o.k = g.k + 1)
select x.id from (select unnest(kept) x from g where k = (select max(k) from o)) where x.id >= 0""")
def dedup_by_id(spark, sf_dir):
    """Greedy exemplars in the order of the ids, at a distance of 20 of 64."""
    scratch = Scratch(spark, "dedup")
    classes = scratch.keep(curate.hash_classes(hashes64(spark, sf_dir), "id", "h"))
    return curate.exemplars(classes.filter("id = class_id"), "id", curate.hash_pairs(classes, 20, BITS), scratch, by_id=True)


@registry.query("csv_scan", "select event_id, user_id, event_type, value from events")
def csv_scan(spark, sf_dir):
    """Events written as CSV and read back under a given schema."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    at = f"{Scratch(spark, 'csv').base}/events"
    tables.write_csv(e, at)
    return tables.read_csv(spark, at, "event_id bigint, user_id bigint, event_type string, value double")


@registry.query("merge_directories", """with s as (select l_partkey k, max(l_quantity) v from lineitem where l_returnflag = 'R' group by 1), d as (select l_partkey k, min(l_quantity) v from lineitem where l_returnflag = 'A' group by 1)
select coalesce(s.k, d.k) k, cast(case when s.k is not null then s.v else d.v end as double) v, case when s.k is not null and d.k is not null then 'both' when s.k is not null then 'source' else 'target' end origin from s full join d on s.k = d.k""")
def merge_directories(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    s = li.filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("k")).agg(F.max("l_quantity").cast("double").alias("v"))
    d = li.filter("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("k")).agg(F.min("l_quantity").cast("double").alias("v"))
    return curate.merge_directories(s, d, "k", "v")


@registry.query("regroup", "with t as (select doc_id, 'STEM-SD-' || coalesce(source, '') || '-SD-' || doc_id as name from documents) select doc_id, source_group as \"group\" from (select t.doc_id, m.source || '!' source_group from t left join mix_target m on m.source = split_part(replace(t.name, 'STEM-SD-', ''), '-SD-', 1))")
def regroup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("STEM-SD-"), F.coalesce("source", F.lit("")), F.lit("-SD-"), "doc_id").alias("name"))
    codes = table(spark, sf_dir, "mix_target").select(F.col("source").alias("code"), F.concat("source", F.lit("!")).alias("group"))
    return curate.regroup(docs, codes, "name", "STEM-SD-", "-SD-").select("doc_id", "group")


@registry.query("proof_batch", f"""with {_NAMES}, i as (select name, patch_id from nm), t as (select patch_id, any_value(axis) axis, any_value(dtype) dtype, any_value(idx) idx from image_patch group by 1),
m as (select name, axis from nm join t using (patch_id) where axis is not null), c as (select name, idx conf from nm join t using (patch_id) where dtype = 'uint8')
select i.name, patch_id, axis, conf from i join m using (name) join c using (name)""")
def proof_batch(spark, sf_dir):
    """Images, masks and confidences of the same name; 2D images have no mask, 16-bit ones no confidence."""
    n = names(spark, sf_dir)
    t = n.join(table(spark, sf_dir, "image_patch").groupBy("patch_id").agg(*[F.first(c).alias(c) for c in ("axis", "dtype", "idx")]), "patch_id")
    masks = t.filter("axis is not null").select("name", "axis")
    conf = t.filter("dtype = 'uint8'").select("name", F.col("idx").alias("conf"))
    return curate.proof_batch(n, masks, conf, "name").select("name", "patch_id", "axis", "conf")


@registry.query("children", f"""with {_NAMES}, i as (select any_value(t.dataset) d, nm.name from nm join image_patch t using (patch_id) group by nm.name), v as (select distinct dataset as name from tracker_meta)
select v.name volume, i.name image from v join i on i.d = v.name and contains(i.name, v.name)""")
def children(spark, sf_dir):
    """Images of a volume: of its directory and with its name in theirs."""
    d = table(spark, sf_dir, "image_patch").groupBy("patch_id").agg(F.first("dataset").alias("directory"))
    i = names(spark, sf_dir).join(d, "patch_id").select("directory", "name")
    v = table(spark, sf_dir, "tracker_meta").select(F.col("dataset").alias("directory"), F.col("dataset").alias("name")).distinct()
    return curate.children(v, i)


@registry.query("content_extent", "with px as (select l_linenumber k, l_suppkey y, l_partkey % 64 x, max(cast(l_quantity as integer) % 3) v from lineitem group by 1, 2, 3) select k, max(y) + 1 h, cast(max(x) + 1 as bigint) w from px where v <> 0 group by 1")
def content_extent(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    px = li.groupBy(F.col("l_linenumber").alias("k"), F.col("l_suppkey").alias("y"), (F.col("l_partkey") % 64).alias("x")).agg(F.max(F.col("l_quantity").cast("int") % 3).alias("v"))
    return curate.content_extent(px, ["k"], "v")


@registry.query("name_sets", """with a as (select distinct s_nationkey k from supplier where s_acctbal > 0), b as (select distinct c_nationkey k from customer where c_acctbal < 0)
select k, 'both' side from (select k from a intersect select k from b) union all select k, 'only' from (select k from a except select k from b)""")
def name_sets(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))
    b = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("k"))
    return curate.name_sets(a, b, "k")
