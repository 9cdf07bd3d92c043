"""Best-fit packing under conflicts.

Pieces of documents go into bins of ``capacity`` words. A bin takes at most one piece
of a source and at most one of a duplicate cluster; it carries both sets as bitmaps.
Open bins are kept in order of their room left. A piece starts at the tightest bin that
has room for it (successor search) and goes on to the next looser ones until one has
neither its source nor its cluster; without one it opens a bin.

Documents are dealt to blocks of about ``block_rows`` by a hash, and each block is packed
by itself, so that no task holds more than a block, however hot a source is. A hash deals
every source over all blocks, and pieces in different blocks can't conflict.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def pack_block(items: Iterable[tuple[int, object, object]], capacity: int) -> list[int]:
    """Bin number of each (size, source, cluster), in the given order; sizes are 1..capacity. None never conflicts."""
    source_bit: dict[object, int] = {}
    cluster_bit: dict[object, int] = {}
    room: list[tuple[int, int]] = []  # (words left, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in items:
        s = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        c = 0 if cluster is None else 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        for i in range(bisect_left(room, (size, -1)), len(room)):
            left, at = room[i]
            if not sources[at] & s and not clusters[at] & c:
                del room[i]
                break
        else:
            left, at = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[at] |= s
        clusters[at] |= c
        if left > size:
            insort(room, (left - size, at))
        out.append(at)
    return out


def best_fit_pack(
    df: DataFrame,
    size: str = "n_words",
    id_col: str = "doc_id",
    source_col: str = "source",
    cluster_col: str = "cluster",
    capacity: int = 2048,
    block_rows: int = 4096,
) -> DataFrame:
    """One row per piece: doc_id, piece, first_word, n_words, source, cluster, bin_id, bin_words.

    A document over ``capacity`` words is cut into pieces of ``capacity`` words and a rest;
    full pieces have a bin of their own. A document without words (or of null size) has one
    row with a null bin. Null sources and clusters never conflict. Within a block larger
    pieces go first, then smaller ids. Repeated rows are packed each by itself.
    """
    rows = df.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"),
        F.col(source_col).alias("source"), F.col(cluster_col).alias("cluster"),
    )
    kinds = dict(rows.dtypes)
    blocks = max(1, -(-rows.count() // block_rows))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "source", "cluster", "size"), F.lit(blocks)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        none = lambda x: None if pd.isna(x) else x
        pieces = []
        for doc, n, source, cluster in pdf[["doc_id", "size", "source", "cluster"]].itertuples(index=False):
            full, rest = divmod(int(n), capacity)
            pieces += [(doc, k, k * capacity, capacity, none(source), none(cluster)) for k in range(full)]
            if rest or not n:
                pieces.append((doc, full, full * capacity, rest, none(source), none(cluster)))
        pieces.sort(key=lambda p: (-p[3], pd.isna(p[0]), p[0] if not pd.isna(p[0]) else 0, p[1]))
        n_full = sum(p[3] == capacity for p in pieces)
        inner = [p for p in pieces[n_full:] if p[3]]
        bins = [*range(n_full), *(n_full + b for b in pack_block([(p[3], p[4], p[5]) for p in inner], capacity))]
        out = pd.DataFrame(pieces, columns=["doc_id", "piece", "first_word", "n_words", "source", "cluster"])
        out["bin_id"] = pd.array([(block << 24) + b for b in bins] + [None] * (len(pieces) - len(bins)), dtype="Int64")
        out["bin_words"] = out.groupby("bin_id")["n_words"].transform("sum").astype("Int64")
        return out

    schema = f"doc_id {kinds['doc_id']}, piece bigint, first_word bigint, n_words bigint, source {kinds['source']}, cluster {kinds['cluster']}, bin_id bigint, bin_words bigint"
    return dealt.groupBy("block").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """best_fit_pack of whole texts, measured in words; the cluster of a text is that of its exact copies (case aside)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(WORD)).alias("n_words"), F.xxhash64(F.lower(text)).alias("cluster"),
    )
    return best_fit_pack(sized, **kw)
