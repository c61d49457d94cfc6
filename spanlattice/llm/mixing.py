"""Mixing sources to target weights: repetition rates per source, then whole copies plus one seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlattice.llm.tokens import count_tokens
from spanlattice.session import Scratch

#: Sources with a target up to which the table of rates is broadcast.
MAX_BROADCAST_SOURCES = 10_000


def source_name(source: Column) -> Column:
    """One spelling of a source: lower case, without white space around."""
    return F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))


def rates(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, tokens, wanted_tokens, rate), one row per source with a target.

    Without ``total`` the mix is the largest one that keeps all shares exact under the caps: with T = min(max_repeats * tokens / share), a source's
    rate is share * T / tokens, at most max_repeats. With ``total`` T is that; a source whose cap does not reach its share of T has its cap as
    rate and falls short by wanted_tokens - rate * tokens. Shares are scaled to add up to 1 over the sources that have
    tokens; a source without tokens cannot hold its share and has rate 0. Shares that are null, not a number or not above 0 and
    caps below 1 take a source out (rate 0); a null cap is 1. Rows of one source after source_name: shares of different
    rows are added, equal rows count once, and the least cap holds. Null sources have no target.
    """
    t = targets.select(source_name(F.col("source")).alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).filter("source is not null").distinct()
    t = t.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    t = t.join(sizes, "source", "left").na.fill(0, ["n_docs", "tokens"])
    fit = (F.col("target_share") > 0) & ~F.isnan("target_share") & (F.col("max_repeats") >= 1) & (F.col("tokens") > 0)
    t = t.withColumn("use", F.when(fit, F.col("target_share")))
    all_ = t.agg(F.sum("use").alias("used"), F.min(F.col("max_repeats") * F.col("tokens") / F.col("use")).alias("per"))  # one row
    per = F.col("per") if total is None else F.lit(float(total)) / F.col("used")  # tokens for each unit of share
    rate = F.when(F.col("use").isNotNull(), F.least(F.col("use") * per / F.col("tokens"), F.col("max_repeats").cast("double")))
    return t.crossJoin(F.broadcast(all_)).select("source", "target_share", "max_repeats", "n_docs", "tokens", F.coalesce(F.col("use") * per, F.lit(0.0)).alias("wanted_tokens"), F.coalesce(rate, F.lit(0.0)).alias("rate"))


def _uniform(key: str, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("bigint"), F.col(key)), 11).cast("double") / F.lit(float(2**53))


class Mix:
    """A selection of documents by source shares.

    Each document is used floor(rate) times, and once more if its seeded hash is below the rate's fraction; so a document's copies
    depend on its id, its source's rate and the seed alone. A source's tokens are then right on average, with a standard
    deviation of sqrt(fraction * (1 - fraction) * sum(tokens^2)), which shares() reports: a few very long texts make it large.

    A document delivered twice (equal bitext_id, pair_seq and text) is used under its least doc_id, so that no text exceeds its source's
    cap; documents whose bitext_id or pair_seq is null stand for themselves. Null sources, sources without a target and
    texts without tokens (null, empty) are not selected. Empty tables give no row; further columns are not read.
    ``characters`` measures sizes in code points instead of tokens; ``total`` see rates. The caller may ``clear`` the ``scratch`` tables.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, path: str, seed: int = 17, total: float | None = None, characters: bool = False):
        self.scratch = scratch = Scratch(docs.sparkSession, "mix")
        same = F.sha2(F.concat_ws("|", "bitext_id", F.col("pair_seq").cast("string"), F.coalesce("text", F.lit(""))), 256)
        known = docs.filter("doc_id is not null").select("doc_id", source_name(F.col("source")).alias("source"), F.when(F.col("bitext_id").isNotNull() & F.col("pair_seq").isNotNull(), same).otherwise(F.concat(F.lit("#"), "doc_id")).alias("same"), "text")
        keys = ["doc_id", "source", "same"]
        counted = known.select(*keys, F.coalesce(F.char_length("text"), F.lit(0)).alias("n_tokens")) if characters else count_tokens(known, keys, "text", path)
        once = counted.filter("n_tokens > 0 and source is not null").groupBy("same").agg(F.min_by(F.struct("doc_id", "source", "n_tokens"), "doc_id").alias("d")).select("d.*")
        self.docs = scratch.keep(once)
        n = F.col("n_tokens").cast("bigint")
        sizes = self.docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(n).alias("tokens"), F.sum(n.cast("double") * n).alias("squares"))
        self.rates = scratch.keep(rates(sizes.drop("squares"), targets, total).join(sizes.select("source", "squares"), "source", "left").na.fill(0, ["squares"]))
        r = self.rates.filter("rate > 0").select("source", F.floor(F.col("rate") + 1e-12).cast("int").alias("whole"), "rate")
        r = r.withColumn("fraction", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))).drop("rate")
        drawn = self.docs.join(F.broadcast(r) if r.count() <= MAX_BROADCAST_SOURCES else r, "source")
        drawn = drawn.withColumn("n_copies", F.col("whole") + F.when(_uniform("doc_id", seed) < F.col("fraction"), 1).otherwise(0))
        self._chosen = drawn.filter("n_copies > 0").select("doc_id", "source", "n_tokens", "n_copies")

    def chosen(self) -> DataFrame:
        """(doc_id, source, n_tokens, n_copies), one row per document used at all."""
        return self._chosen

    def selection(self) -> DataFrame:
        """(doc_id, source, copy_no, n_tokens): each copy a row."""
        return self.chosen().select("doc_id", "source", F.explode(F.sequence(F.lit(1), "n_copies")).alias("copy_no"), "n_tokens")

    def plan(self) -> DataFrame:
        """Per source with a target what the rates promise: whole copies, the chance of one more, tokens expected, their standard deviation, and what the cap leaves short of the wanted tokens."""
        whole = F.floor(F.col("rate") + 1e-12)
        fraction = F.greatest(F.col("rate") - whole, F.lit(0.0))
        expected = F.col("rate") * F.col("tokens")
        return self.rates.select("source", "target_share", "max_repeats", "n_docs", F.col("tokens").alias("source_tokens"), "rate", whole.cast("int").alias("whole_copies"), fraction.alias("fraction"), expected.alias("expected_tokens"), F.sqrt(fraction * (1 - fraction) * F.col("squares")).alias("tokens_sd"), F.greatest(F.col("wanted_tokens") - expected, F.lit(0.0)).alias("short_tokens"))

    def shares(self) -> DataFrame:
        """plan() with the tokens, copies and share reached; expected_share is that of the expected tokens."""
        got = self.chosen().groupBy("source").agg(F.sum(F.col("n_tokens").cast("bigint") * F.col("n_copies")).alias("mixed_tokens"), F.max("n_copies").alias("most_copies"))
        out = self.plan().join(got, "source", "left").na.fill(0, ["mixed_tokens", "most_copies"])
        total = out.agg(F.sum("mixed_tokens").alias("_total"), F.sum("expected_tokens").alias("_expected"))  # one row
        share = lambda a, b: (F.col(a) / F.nullif(F.col(b), F.lit(0))).alias("expected_share" if b == "_expected" else "actual_share")
        return out.crossJoin(F.broadcast(total)).select(*out.columns, share("expected_tokens", "_expected"), share("mixed_tokens", "_total"))
