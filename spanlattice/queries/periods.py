"""Problem 4: overlapping and gapped intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlattice.operators.periods import periods_and_gaps
from spanlattice.queries import Registry
from spanlattice.session import table

registry = Registry()

_PERIODS = """
with x as (select object_id, unnest(starts) s, unnest(runs) r from tracked_object where object_id is not null),
iv as (select object_id, s, s + r e from x where s is not null and r >= 1),
m as (select *, max(e) over (partition by object_id order by s, e rows between unbounded preceding and 1 preceding) pe from iv),
g as (select *, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by object_id order by s, e rows unbounded preceding) k from m),
p as (select object_id, min(s) s, max(e) e from g group by object_id, k),
spans as (select object_id, 'period' span_kind, s first_idx, e end_idx from p
  union all select * from (select object_id, 'gap', e, lead(s) over (partition by object_id order by s) n from p) where n is not null)
"""


@registry.query("p4_found", _PERIODS + "select * from spans")
def p4_found(spark, sf_dir):
    return periods_and_gaps(table(spark, sf_dir, "tracked_object"), "object_id")


@registry.query("p4_blocks", _PERIODS + "select * from spans")
def p4_blocks(spark, sf_dir):
    """As p4_found, with objects of more than 40 intervals cut into blocks of about 1,000, so that the path for very large ones runs."""
    return periods_and_gaps(table(spark, sf_dir, "tracked_object"), "object_id", hot_intervals=40, block_intervals=1000)


@registry.query(
    "p4_coverage",
    _PERIODS + """select object_id, cast(count(*) filter (span_kind = 'period') as bigint) n_periods,
      cast(sum(case when span_kind = 'period' then end_idx - first_idx else 0 end) as bigint) covered,
      cast(sum(case when span_kind = 'gap' then end_idx - first_idx else 0 end) as bigint) uncovered from spans group by 1""",
)
def p4_coverage(spark, sf_dir):
    """One row per object: its number of periods, and the indices covered and left out between first and last."""
    spans = periods_and_gaps(table(spark, sf_dir, "tracked_object"), "object_id")
    length, is_period = F.col("end_idx") - F.col("first_idx"), F.col("span_kind") == "period"
    return spans.groupBy("object_id").agg(
        F.count(F.when(is_period, 1)).alias("n_periods"),
        F.sum(F.when(is_period, length).otherwise(0)).alias("covered"),
        F.sum(F.when(is_period, 0).otherwise(length)).alias("uncovered"),
    )
