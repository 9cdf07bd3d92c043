"""Exact deduplication by skew-safe combining, native DataFrame operations only.

Three stages, each of which compares the full text, because the text is part of
every grouping key:

1. local: Spark's map-side aggregation folds equal texts of an input partition;
2. salted: groups of (digest, salt, text) merge, so that a text with millions of
   copies meets in ``salts`` tasks and not in one;
3. global: the at most ``salts`` winners of a text merge into one.

Rows then learn their winner by a join on the digest alone. That is exact as long
as stage 3 found one text for each digest; it counts the texts of each digest,
and digests that more than one text shares are joined on the text as well. Groups of
more than 1/``SHARE`` of all rows, of which there are fewer than ``SHARE``, are joined
by broadcast and their rows spread, so that no key of the shuffled join holds more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceforge.llm.common import checkpoint, id_and_text

SHARE = 1000


def text_groups(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, text, keep_id, group_size): one row for each distinct text."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts))
    salted = rows.groupBy("digest", salt.alias("salt"), "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical. Of equal texts the row with the largest id stays.
    Null text: equal to the empty text. Null id: counts in the group and is never kept
    while another row of the group has an id; keep_id is null if none has. Rows that
    repeat the winning id are the same document and are all kept. An empty table gives
    no rows. Columns other than the two are not read. ``digest`` (an expression over
    ``text``) replaces SHA-256 as the grouping digest; collisions stay exact.
    """
    rows = id_and_text(df, id_col, text_col).withColumn("digest", F.sha2("text", 256) if digest is None else digest)
    groups = text_groups(rows, salts)
    # the text stays behind here: digests are joined back, not texts
    by_digest = checkpoint(groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")))
    sha = F.col("digest") if digest is None else F.sha2("text", 256)
    one = by_digest.where("texts = 1").drop("texts")
    total = one.agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("n")).first()["n"]
    large = F.col("group_size") * SHARE > F.lit(total)
    hot = one.where(large).select("digest", F.struct("keep_id", "group_size").alias("hot"))  # fewer than SHARE rows, as their sizes add up to the total at most
    cold = one.where(~large).select("digest", F.struct("keep_id", "group_size").alias("cold"), F.lit(-1).cast("bigint").alias("spread"))
    dealt = rows.select("doc_id", "digest", sha.alias("text_sha256")).join(F.broadcast(hot), "digest", "left")
    dealt = dealt.withColumn("spread", F.when(F.col("hot").isNull(), F.lit(-1).cast("bigint")).otherwise(F.shiftrightunsigned(F.xxhash64("doc_id"), 1)))
    met = dealt.join(cold, ["digest", "spread"], "left").withColumn("found", F.coalesce("hot", "cold")).where("found is not null")
    out = met.select("doc_id", "digest", "text_sha256", "found.keep_id", "found.group_size")
    shared = by_digest.where("texts > 1").select("digest")
    if not shared.isEmpty():
        again = rows.join(shared, "digest", "left_semi")
        out = out.unionByName(again.join(text_groups(again, salts), ["digest", "text"]).select("doc_id", "digest", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"))
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       coalesce(doc_id = max(doc_id) OVER g, false) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
