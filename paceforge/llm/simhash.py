"""Near-duplicates by SimHash and an inverted index over byte positions.

Two 64-bit fingerprints that differ in at most 3 bits share at least 8 - 3 = 5 of
their 8 positional bytes. Posting single bytes would give lists of n / 256 entries,
whose pairs grow with the square of the corpus, so the index posts triples: of any 5
byte positions 3 lie in the same half of the word, and each half has four triples.
Every pair with 5 shared bytes therefore meets in at least one of 8 lists of 24-bit
keys, and no pair within 3 bits is missed. Inside a list the shared positional bytes
of each pair are tallied, pairs that reach 5 are kept, and their bits are counted.

Equal fingerprints are one node. A list reports a spanning forest of its links and
not all its pairs: linked nodes stay connected, and what leaves a task is smaller
than its list. Lists over ``list_limit`` nodes are dealt anew by further bits: the 40
other bits differ in at most 3 places, so one of 4 blocks of them is equal again.

With several words per fingerprint (``n_words`` > 1) the same index finds pairs that
share a triple in any word, and the distance over all bits decides. It is then not
exact; ``near_duplicates`` takes it as a first proposer and finds the rest by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceforge.llm.common import LOWER, checkpoint, id_and_text, map_rows, remove_folder, scratch_folder, word_hashes, written
from paceforge.llm.components import connected_components
from paceforge.llm.decontaminate import window_hashes

MAX_BITS, MIN_BYTES = 3, 5
CELLS, PAGE = 1 << 20, 1 << 12
# odd multipliers of the splitmix64 generator, for further words from one hash
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def shingles(text: str | None, size: int) -> list[bytes]:
    ws = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if len(ws) <= size:
        return [b" ".join(ws)] if ws else []
    return list(map(b" ".join, zip(*(ws[i:] for i in range(size)), strict=False)))


def fingerprint(text: str | None, size: int = 3, n_words: int = 1) -> list[int]:
    """Words of a text's fingerprint as signed 64-bit numbers; zeros without shingles.

    A bit is 1 if it is set in over half of the shingles' XXH64 (seed 42), repeats
    included; further words use the same hashes, mixed by splitmix64 with the word's number.
    """
    from xxhash import xxh64_intdigest

    found = shingles(text, size)
    if not found:
        return [0] * n_words
    return majority(np.fromiter((xxh64_intdigest(s, 42) for s in found), np.uint64, len(found)), n_words)


def majority(h: np.ndarray, n_words: int = 1) -> list[int]:
    """Words of the fingerprint of shingles with hashes ``h``; zeros without any."""
    if not len(h):
        return [0] * n_words
    out = []
    for k in range(n_words):
        if k:
            x = h + np.uint64((k * 0x9E3779B97F4A7C15) % 2**64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
            x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
            x ^= x >> np.uint64(31)
        else:
            x = h
        ones = np.zeros(64, np.int64)
        for at in range(0, len(x), 16384):
            ones += np.unpackbits(x[at : at + 16384].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(x), bitorder="little").view("<i8")[0]))
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, n_words: int = 1) -> DataFrame:
    """(doc_id, print array<bigint>), one row per input row; null text: as the empty text, all zeros."""
    rows = id_and_text(df, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    return map_rows(rows, f"doc_id {kind}, print array<bigint>", lambda: lambda r: [(r["doc_id"], fingerprint(r["text"], size, n_words))])


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def key_masks(level: int) -> list[int]:
    """Masks of the index keys: 8 byte triples, and 4 more blocks of the free bits for each level below."""
    masks = []
    for half in (0, 4):
        for out in range(half, half + 4):
            masks.append(sum(0xFF << 8 * b for b in range(half, half + 4) if b != out))
    for _ in range(level):
        deeper = []
        for m in masks:
            free = [i for i in range(64) if not m >> i & 1]
            cuts = [len(free) * i // 4 for i in range(5)]
            deeper += [m | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        masks = deeper
    return masks


def forest(prints: np.ndarray, max_bits: int, min_bytes: int) -> Iterator[tuple[int, int]]:
    """Spanning forest of the links among the rows of ``prints`` (nodes x words, uint64), breadth first.

    Each step compares one node with those not reached yet; a list of near copies is
    done after a few steps.
    """
    left = np.arange(len(prints))
    queue: list[int] = []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        node = queue.pop()
        apart = prints[left] ^ prints[node]
        near = np.bitwise_count(apart).sum(axis=1) <= max_bits
        if min_bytes:
            near &= (apart.view(np.uint8).reshape(len(left), -1, 8) == 0).sum(axis=2).max(axis=1) >= min_bytes
        for other in left[near].tolist():
            yield node, other
            queue.append(other)
        left = left[~near]


def links(nodes: DataFrame, max_bits: int = MAX_BITS, min_bytes: int = MIN_BYTES, list_limit: int = 32768, levels: int = 3, folder: str | None = None) -> DataFrame:
    """(a, b array<bigint>): links between the distinct fingerprints in ``nodes.print`` that keep linked ones connected."""

    def post(df: DataFrame, level: int) -> DataFrame:
        """level 0: (print); below: (print, word, mask), where each mask has four finer ones."""
        masks = F.array(*(F.lit(_signed(m)) for m in key_masks(level)))
        if level == 0:
            spread = df.select("print", F.posexplode("print").alias("word", "value"))
            spread = spread.select("print", "word", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("mask"))
        else:
            spread = df.select("print", "word", F.explode(F.sequence(F.col("mask") * 4, F.col("mask") * 4 + 3)).alias("mask"))
        value = F.element_at("print", F.col("word") + 1)
        return spread.withColumn("key", value.bitwiseAND(F.element_at(masks, F.col("mask") + 1)))

    keys = ["word", "mask", "key"]
    posts, lists = post(nodes.select("print").distinct(), 0), []
    for level in range(levels + 1):
        if level == levels:
            lists.append(posts)
            break
        long = written(posts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > list_limit).drop("n"), folder)
        if long.isEmpty():
            lists.append(posts)
            break
        lists.append(posts.join(long, keys, "left_anti"))
        posts = post(posts.join(long, keys, "left_semi"), level + 1)

    def start():
        def one(r):
            nodes = sorted(r["prints"])
            arr = np.array(nodes, np.int64).view(np.uint64)
            for i, j in forest(arr, max_bits, min_bytes):
                yield nodes[i], nodes[j]

        return one

    found = [map_rows(x.groupBy(*keys).agg(F.collect_set("print").alias("prints")).where(F.size("prints") > 1).select("prints"), "a array<bigint>, b array<bigint>", start) for x in lists]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def classes(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """(print, component_id): the smallest doc_id that links lead to from a fingerprint."""
    first = prints.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(edges)
    rooted = first.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    low = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(low, "root").select("print", "component_id")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Words, shingles and bits as in ``fingerprint``; at most 3 bits apart is a link.
    Texts without words (null, empty, white space) have fingerprint zero and link like
    any other. Repeated rows share their component. A row with a null id links others,
    but never names a component unless no linked row has an id. An empty table gives no rows.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the triples of bytes are exact up to 3 bits")
    prints = checkpoint(fingerprints(df, id_col, text_col, size))
    member = classes(prints, checkpoint(links(prints, max_bits, 8 - max_bits)))
    return prints.join(member, "print").select("doc_id", F.lower(F.lpad(F.hex(F.element_at("print", 1)), 16, "0")).alias("fingerprint"), "component_id")


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles, made of the words' hashes."""
    h = word_hashes([text or ""], LOWER)[0]
    own = min(size, len(h))
    return np.unique(window_hashes(h, own, own)) if own else h


def shingle_ranks(rows: DataFrame, size: int) -> np.ndarray:
    """Rank (three steps an octave) of each of ``CELLS`` hash cells by the shingles that fall in it; 1 MB at any size of the input."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = np.zeros(CELLS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for text in batch.slice(at, 64).column(0).to_pylist():
                    np.add.at(held, (shingle_hashes(text, size) & np.uint64(CELLS - 1)).astype(np.int64), 1)
        for page in range(CELLS // PAGE):
            own = held[page * PAGE : (page + 1) * PAGE]
            full = np.flatnonzero(own)
            if len(full):
                yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([full.astype(np.uint16).tobytes()], pa.binary()), pa.array([own[full].astype(np.int64).tobytes()], pa.binary())], ["page", "cells", "n"])

    def add(pages):
        import pandas as pd

        total = np.zeros(PAGE, np.int64)
        for cells, n in zip(pages["cells"], pages["n"], strict=True):
            total[np.frombuffer(cells, np.uint16)] += np.frombuffer(n, np.int64)
        rank = np.floor(3 * np.log2(np.maximum(total, 1))).astype(np.uint8)
        return pd.DataFrame({"page": [pages["page"].iloc[0]], "ranks": [rank.tobytes()]})

    out = np.zeros(CELLS, np.uint8)
    for r in rows.select("text").mapInArrow(count, "page int, cells binary, n binary").groupBy("page").applyInPandas(add, "page int, ranks binary").collect():  # CELLS bytes in all
        out[r["page"] * PAGE : (r["page"] + 1) * PAGE] = np.frombuffer(bytes(r["ranks"]), np.uint8)
    return out


def _least(t: float, n: int) -> int:
    return int(np.ceil(t * n - 1e-9))


def shared_in_prefix(t: float, n: int) -> int:
    """Shingles that two matching sets share in their prefixes, the smaller one of ``n``; it never falls as n grows."""
    return min(1 + n // 20, _least(t, n))


def digested(rows: DataFrame) -> DataFrame:
    """With a digest that stands for the text."""
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def similar_pairs(pairs: DataFrame, known: DataFrame, rows: DataFrame, size: int, similarity: float, folder: str) -> DataFrame:
    """The pairs (a, b) of rows of (row, digest) whose texts, in ``rows``, are similar enough: whole sets of shingles are compared. Only texts of a pair are kept."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    ids = written(known.select("row", "digest").join(ids, "row", "left_semi"), folder)
    texts = digested(rows.select("text")).join(ids, "digest")
    texts = written(texts.groupBy("row").agg(F.first("text").alias("text")), folder)  # copies are one
    a, b = (texts.select(F.col("row").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab")

    def start():
        def one(r):
            x, y = set(shingles(r["text_a"], size)), set(shingles(r["text_b"], size))
            if len(x & y) >= similarity * len(x | y) - 1e-9:
                yield r["a"], r["b"]

        return one

    return map_rows(pairs.join(a, "a").join(b, "b"), "a bigint, b bigint", start)


def parity(h: np.ndarray) -> list[int]:
    """256 bits, as four numbers: how many of the hashes fall on each, modulo 2. Sets that differ in d members differ in at most d bits."""
    odd = np.bincount((h >> np.uint64(40) & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def pairs_across(sets: DataFrame, similarity: float, folder: str) -> DataFrame:
    """(a, b): of the pairs in (row, comp, n, sig, prefix) of different ``comp`` a set that holds all similar ones.

    Overlap o of similar sets is at least t |x| and t |y|. The k-th smallest shingle that they
    share is then among the first |x| - o + k of x, and of y likewise, in any order of the
    shingles. So they share k in these prefixes; each must also leave room for o at its places,
    and the parities must leave room for it too. A list of shingle holders within one component
    is not read, and within a list only holders of different components meet: each of the
    component that has fewer there with those of the other that pass all filters.
    """
    t = similarity
    least = lambda share, n: F.ceil(F.lit(share) * n - F.lit(1e-9))
    bits = [f"s{k}" for k in range(4)]
    posts = sets.select("row", "comp", "n", F.posexplode("prefix").alias("i", "key"))
    live = posts.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    sigs = sets.select("row", *(F.element_at("sig", k + 1).alias(c) for k, c in enumerate(bits)))
    posts = written(written(posts.join(live, "key", "left_semi"), folder).join(sigs, "row"), folder)

    def sides(df: DataFrame, s: str) -> DataFrame:
        return df.select("key", *(F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "key"))

    differ = sum(F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in bits)
    total = F.col("n_a") + F.col("n_b")
    room = differ <= total - 2 * least(t / (1 + t), total)
    held = posts.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("held"), F.min("n").alias("n"), F.max("n").alias("most"), *(F.min(c).alias(c) for c in bits))
    one, other = sides(held, "a"), sides(held, "b").withColumnRenamed("key", "key_b")
    fewer = (F.col("held_a") < F.col("held_b")) | ((F.col("held_a") == F.col("held_b")) & (F.col("comp_a") < F.col("comp_b")))
    long_enough = (F.col("most_a") >= least(t, F.col("n_b"))) & (F.col("most_b") >= least(t, F.col("n_a")))
    alone = (F.col("held_a") == 1) & (F.col("held_b") == 1)
    cross = one.join(other, (F.col("key") == F.col("key_b")) & fewer & (F.col("comp_a") != F.col("comp_b")) & long_enough & (~alone | room)).select("key", "comp_a", "comp_b")
    first = cross.join(sides(posts, "a"), ["key", "comp_a"])
    second = sides(posts, "b").withColumnRenamed("key", "key_b").withColumnRenamed("comp_b", "comp_of_b")
    small, need = F.least("n_a", "n_b"), least(t / (1 + t), total)
    shared = F.least(1 + F.floor(small / 20), least(t, small))
    fits = room & (small >= least(t, F.greatest("n_a", "n_b"))) & (F.least("i_a", "i_b") + F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b")) >= need)
    for s in "ab":
        fits &= F.col(f"i_{s}") < F.col(f"n_{s}") - need + shared
    met = first.join(second, (F.col("key") == F.col("key_b")) & (F.col("comp_b") == F.col("comp_of_b")) & fits)
    met = met.groupBy(F.col("row_a").alias("a"), F.col("row_b").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.first(shared).alias("need"))
    return met.where("shared >= need").select("a", "b")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, n_words: int = 6) -> DataFrame:
    """(doc_id, component_id) of documents whose sets of ``size``-word shingles have Jaccard similarity of at least ``similarity``.

    Exact: groups are what all similar pairs connect. Documents with the same set fold into
    one. The index of fingerprints of ``n_words`` words then proposes links at little cost: its
    lists give spanning forests, and it may miss pairs. The texts of each proposal are compared
    in full. What these links leave in different components goes through a prefix-filtered
    join of the sets, rare shingles first, and is compared in full too; so a pair that the
    index missed, or a link that its forest left out, is found here. Documents without words
    are alike. Null ids and repeated rows as in ``simhash_components``.
    """
    rows = id_and_text(df, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    folder = scratch_folder(rows.sparkSession)
    ranks = rows.sparkSession.sparkContext.broadcast(shingle_ranks(rows, size))

    def start():
        from xxhash import xxh64_intdigest

        def one(r):
            h = shingle_hashes(r["text"], size)
            n, raw = len(h), h.tobytes()
            rank = ranks.value[(h & np.uint64(CELLS - 1)).astype(np.int64)]
            order = np.lexsort((h, rank))[: n - _least(similarity, n) + shared_in_prefix(similarity, n)]
            yield r["row"], r["doc_id"], r["digest"], _signed(xxh64_intdigest(raw, 1)), _signed(xxh64_intdigest(raw, 2)), n, majority(h, n_words), h[order].view(np.int64).tolist(), parity(h)

        return one

    # the number of a row is fixed by writing it; texts are not written again, as few are in a pair
    numbered = digested(rows).withColumn("row", F.monotonically_increasing_id())
    known = written(map_rows(numbered, f"row bigint, doc_id {kind}, digest binary, d1 bigint, d2 bigint, n int, print array<bigint>, prefix array<bigint>, sig array<bigint>", start), folder)
    sets = written(known.groupBy("d1", "d2").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), folder)
    again = known.select("row", "d1", "d2").join(sets.where("copies > 1"), ["d1", "d2"]).where("row <> node").select("row")
    firsts = known.join(again, "row", "left_anti")

    cosine = 2 * similarity / (1 + similarity)  # of equally large sets
    share = float(np.arccos(cosine) / np.pi)
    bits = int(64 * n_words * (share + 2 * np.sqrt(share * (1 - share) / (64 * n_words))))
    lead = firsts.groupBy("print").agg(F.min("row").alias("lead"))
    same = firsts.select("print", "row").join(lead, "print").where("row <> lead").select(F.col("lead").alias("a"), F.col("row").alias("b"))
    near = links(firsts.select("print"), bits, 3, folder=folder).distinct()
    for s in "ab":
        near = near.withColumnRenamed(s, "print").join(lead, "print").drop("print").withColumnRenamed("lead", s)
    quick = written(similar_pairs(written(near.select("a", "b").unionByName(same), folder), known, rows, size, similarity, folder), folder)
    roots = connected_components(quick)
    placed = firsts.select("row", "n", "prefix", "sig").join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("comp", F.coalesce("root", "row"))
    rest = similar_pairs(written(pairs_across(placed, similarity, folder), folder), known, rows, size, similarity, folder)
    roots = connected_components(quick.unionByName(written(rest, folder)))
    rooted = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(low, "root").select("d1", "d2", "component_id")
    out = written(known.select("doc_id", "d1", "d2").join(named, ["d1", "d2"]).select("doc_id", "component_id"))
    remove_folder(rows.sparkSession, folder)
    return out


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``df``, all columns, that stay: of each group the one with the smallest id.

    Rows with a null id stay, as nothing tells them apart.
    """
    gone = near_duplicates(df, id_col, text_col, **kw).where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return df.join(gone, id_col, "left_anti").select(*df.columns)
