"""Language-model scores from a log-frequency Bloom filter.

The model is a bigram model with a Dirichlet prior on the unigram distribution:

    p(w | h) = (c(h, w) + m p(w)) / (c(h) + m),   p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))

Its counts live in one Bloom filter: an n-gram of count c is stored under the levels
1 .. 1 + floor(log_b c), and a worker finds the level by probing 1, 2, 3, ... until one is
absent. A level stands for the middle of its counts. All words and bigrams are stored,
those seen once too. Filters have no false negatives, so a level is never too low; it is
too high for about 1 % of n-grams (``BITS`` bits and ``PROBES`` probes for each level stored).

Mass: with exact counts p(. | h) sums to 1 over the vocabulary and one unseen word. A
middle is at most a quarter above or a fifth below its counts, so with levels the sum lies
between 0.64 and 1.57, and near 1 for contexts with many followers.

The filter is built in shards of some ``shard_tokens`` tokens, each as large as its own
entries ask for. What it holds follows from the corpus alone and grows with it. A broadcast
holds whole shards of ``part_mb`` MB at most; a larger filter is probed in several passes,
one part of it at a time, whose levels are put together. The scores are the same.

The base score needs exact counts. At most ``top_words`` frequent words (16 bytes each) are
broadcast, all other words meet their counts in a join. Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceforge.llm.common import LOWER, bucket_of, id_and_text, word_hashes, written

START, END = 0x2545F4914F6CDD1D, 0x27D4EB2F165667C5
BASE, PROBES, BITS, MAX_LEVEL = 1.5, 6, 11, 64
ALPHA = 0.1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bigrams(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + tokens)


def level_values() -> np.ndarray:
    """Middle of the whole counts at each level, 0 for level 0."""
    low = np.ceil(BASE ** np.arange(MAX_LEVEL + 1) - 1e-9)
    high = np.maximum(low, np.ceil(BASE ** np.arange(1, MAX_LEVEL + 2) - 1e-9) - 1)
    return np.concatenate([[0.0], (low + high) / 2])


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64), MAX_LEVEL)


def pieces(batches: Iterator, most: int = 1 << 20) -> Iterator:
    """Slices of the batches of at most 512 rows, and of not much over ``most`` bytes of text (column 1) if over one row."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 512]), most, "right")))
            yield batch.slice(at, n)
            at += n


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text closed by the end token, and the place where each text begins."""
    h, counts = word_hashes(texts, LOWER)
    ends = np.cumsum(counts + 1)
    w = np.full(len(h) + len(texts), END, np.uint64)
    own = np.ones(len(w), bool)
    own[ends - 1] = False
    w[own] = h
    return w, ends - counts - 1


def pairs_of(w: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.empty_like(w)
    before[1:] = w[:-1]
    before[first] = START
    return bigrams(before, w)


def summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n.astype(np.int64), first) if len(h) else n


def ngram_counts(train: DataFrame, shards: int) -> DataFrame:
    """(shard, word, h, n): words and bigrams of each part of the input, packed by shard; ``word`` says which. Sums are left to the caller."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def flush(held: list, word: bool) -> Iterator:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            shard = Filter.shard(h, shards)
            order = np.argsort(shard, kind="stable")
            h, n, own = h[order], n[order].astype(np.uint32), np.arange(shards)
            low, high = np.searchsorted(shard[order], own), np.searchsorted(shard[order], own, "right")
            full = np.flatnonzero(high > low)
            for at in range(0, len(full), 64):
                some = full[at : at + 64]
                packed = [pa.array([x[low[s] : high[s]].tobytes() for s in some], pa.binary()) for x in (h, n)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([word] * len(some)), *packed], ["shard", "word", "h", "n"])

        words: list[np.ndarray] = []
        pairs: list[np.ndarray] = []
        for part in pieces(batches):
            w, first = tokens_of(part.column(1).to_pylist())
            words.append(w)
            pairs.append(pairs_of(w, first))
            if sum(map(len, words)) > 3_000_000:
                yield from flush(words, True)
                yield from flush(pairs, False)
                words, pairs = [], []
        if words:
            yield from flush(words, True)
            yield from flush(pairs, False)

    return train.select("doc_id", "text").mapInArrow(run, "shard int, word boolean, h binary, n binary")


@dataclass
class Filter:
    """Shards of bits, one after another; an n-gram's hash names its shard, its levels are places in it. A shard that is not held has 0 bits."""

    bits: np.ndarray  # uint8
    at: np.ndarray  # first byte of each shard, and the end

    @staticmethod
    def spot(start: np.ndarray, level: int, blocks: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """First bit of the block of 512 bits that holds a level of n-grams, and a number that names the places in it. Under 2^32 blocks."""
        x = mixed(start + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
        return (x >> np.uint64(32)) * blocks >> np.uint64(32) << np.uint64(9), (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    @staticmethod
    def place(block: np.ndarray, inside: np.ndarray, i: int) -> np.ndarray:
        return (block + (inside >> np.uint64(55 - 9 * i) & np.uint64(511))).astype(np.int64)

    @staticmethod
    def shard(h: np.ndarray, shards: int) -> np.ndarray:
        return (mixed(h ^ np.uint64(0x632BE59BD9B4E019)) % np.uint64(shards)).astype(np.int64)

    @staticmethod
    def fill(h: np.ndarray, top: np.ndarray) -> bytes:
        """The bits of a shard that holds the n-grams ``h`` of levels ``top``."""
        blocks = -(-BITS * int(top.sum()) // 512)
        flags, start = np.zeros(blocks * 512, bool), mixed(h)
        for level in range(1, int(top.max(initial=0)) + 1):
            here = top >= level
            start, top = start[here], top[here]
            block, inside = Filter.spot(start, level, np.uint64(blocks))
            for i in range(PROBES):
                flags[Filter.place(block, inside, i)] = True
        return np.packbits(flags, bitorder="little").tobytes()

    def level(self, h: np.ndarray) -> np.ndarray:
        """Level of each n-gram, 0 if absent: probe level after level while all bits are set."""
        out = np.zeros(len(h), np.uint8)
        shard = self.shard(h, len(self.at) - 1)
        base, blocks = self.at[shard].astype(np.uint64) << np.uint64(3), ((self.at[shard + 1] - self.at[shard]) >> 6).astype(np.uint64)
        alive = np.flatnonzero(blocks)
        start, base, blocks = mixed(h[alive]), base[alive], blocks[alive]
        for level in range(1, MAX_LEVEL + 1):
            block, inside = self.spot(start, level, blocks)
            block += base
            ok = np.ones(len(alive), bool)
            for i in range(PROBES):
                at = self.place(block, inside, i)
                ok &= self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
            alive, start, base, blocks = alive[ok], start[ok], base[ok], blocks[ok]
            if not len(alive):
                break
            out[alive] = level
        return out


def built(counts: DataFrame, shards: int) -> DataFrame:
    """(shard, bits, h, c): the bits of each shard, and with null bits the words with their counts. A task gets whole shards."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[tuple, list] = {}
        for batch in batches:
            for shard, word, h, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault((shard, word), []).append((np.frombuffer(h, np.int64), np.frombuffer(n, np.uint32)))
        for s in sorted({s for s, _ in held}):
            (wh, wc), (ph, pc) = (summed(*(np.concatenate(x) for x in zip(*held.pop((s, word)), strict=True))) if (s, word) in held else (np.zeros(0, np.int64),) * 2 for word in (True, False))
            bits = Filter.fill(np.concatenate([wh, ph]).view(np.uint64), levels_of(np.concatenate([wc, pc])))
            size = len(wh) + 1
            columns = [pa.array([s] * size, pa.int32()), pa.array([bits] + [None] * len(wh), pa.binary()), pa.array(np.concatenate([[0], wh])), pa.array(np.concatenate([[0], wc]))]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "bits", "h", "c"])

    return counts.repartitionById(shards, F.col("shard")).select("shard", "word", "h", "n").mapInArrow(run, "shard int, bits binary, h bigint, c bigint")


def parts_of(bits: DataFrame, shards: int, part_mb: int) -> Iterator[Filter]:
    """The filter in parts of whole shards, ``part_mb`` MB at most (one shard if that is larger)."""
    sizes = np.zeros(shards, np.int64)
    for r in bits.select("shard", F.octet_length("bits").alias("n")).collect():  # two numbers for each shard
        sizes[r["shard"]] = r["n"]
    low = 0
    while low < shards:
        high = max(low + 1, low + int(np.searchsorted(np.cumsum(sizes[low:]), part_mb << 20, "right")))
        at = np.concatenate([[0], np.cumsum(np.where((np.arange(shards) >= low) & (np.arange(shards) < high), sizes, 0))])
        out = np.zeros(int(at[-1]), np.uint8)
        for r in bits.where(F.col("shard").between(low, high - 1)).toLocalIterator():
            out[at[r["shard"]] : at[r["shard"] + 1]] = np.frombuffer(bytes(r["bits"]), np.uint8)
        yield Filter(out, at)
        low = high


def frequent_words(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the words of at least such a count that no more than ``most`` have it; 16 bytes each.

    The count is read off a histogram (eight steps an octave), so that nothing is sorted on the way.
    """
    step = F.floor(8 * F.log2("c")).cast("int")
    bins = {r["s"]: r["n"] for r in words.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, held = 512, 0
    for s in sorted(bins, reverse=True):
        held += bins[s]
        if held > most:
            break
        least = s

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            h, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array([h.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], ["h", "c"])

    parts = words.where(step >= least).select("h", "c").mapInArrow(pack, "h binary, c binary").collect()
    h, c = (np.concatenate([np.frombuffer(bytes(r[i]), np.int64) for r in parts] or [np.zeros(0, np.int64)]) for i in (0, 1))
    order = np.argsort(h)
    return h[order], c[order]


def looked_up(keys: np.ndarray, table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values of the keys in a sorted table, 0 for others."""
    if not len(table):
        return np.zeros(len(keys), values.dtype)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], 0)


def probe(lm: Filter, known: np.ndarray, known_levels: np.ndarray, w: np.ndarray, back: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels of the tokens ``w[back]`` and of their bigrams. The levels of ``known`` words were probed before; each other n-gram is probed once."""
    word = looked_up(w.view(np.int64), known, known_levels)
    rare = np.flatnonzero(word == 0)
    word[rare] = lm.level(w[rare])
    own, at = np.unique(pairs, return_inverse=True)
    return word[back], lm.level(own)[at]


def probabilities(word: np.ndarray, pair: np.ndarray, first: np.ndarray, n_texts: int, n: int, v: int, prior: float) -> np.ndarray:
    """p(w | h) of each token from the levels of the tokens and of their bigrams."""
    values = level_values()
    c, joint = values[word], values[pair]
    context = np.empty_like(c)
    context[1:] = c[:-1]  # a token's context is the token before
    context[first] = values[levels_of(np.array([n_texts]))[0]] if n_texts else 0
    context = np.maximum(context, joint)  # a context is at least as frequent as what follows it
    return (joint + prior * (c + ALPHA) / (n + ALPHA * (v + 1))) / (context + prior)


def score_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out: Column | None = None,
    prior: float = 8.0,
    shard_tokens: int = 1 << 20,
    part_mb: int = 128,
    top_words: int = 1 << 17,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows for which ``held_out`` (an expression over doc_id; default: crc32 of
    the id as text, modulo 10, is 0) is false. Null texts are empty and have the end token
    only. Repeated rows count each in training and give repeated results; a null id is hashed
    as the empty text. Without rows to learn from N and V are 0 and every probability is
    that of one unseen token, p = 1. ``shard_tokens`` decides how much a task that builds a
    shard holds (some 16 bytes a token), ``part_mb`` how much a broadcast.
    """
    rows = id_and_text(docs, id_col, text_col)
    rows = rows.select("doc_id", "text", (bucket_of("doc_id", 10) == 0 if held_out is None else held_out).alias("held_out"))
    kind = dict(rows.dtypes)["doc_id"]
    train = rows.where(~F.col("held_out")).select("doc_id", "text")
    context = rows.sparkSession.sparkContext
    # a word takes two bytes at least, with its blank; a text has one token more
    facts = train.agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    n_texts, shards = int(facts["texts"]), max(1, -(-int(facts["size"]) // 6 // shard_tokens))
    table = written(built(ngram_counts(train, shards), shards))
    words, bits = table.where("bits is null").select("h", "c"), table.where("bits is not null").select("shard", "bits")
    facts = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, n_words = int(facts["n"]), int(facts["v"])
    unit = np.log10(n_train + ALPHA * (n_words + 1))
    top = frequent_words(words, top_words)
    frequent = context.broadcast(top)

    def levels(shared, part) -> tuple:
        """Tokens and their levels by this part of the filter, put together with those of earlier parts in the column ``levels``, if it is there."""
        w, first = tokens_of(part.column(1).to_pylist())
        own, back = np.unique(w, return_inverse=True)
        bits, at, known_levels = shared.value
        word, pair = probe(Filter(bits, at), frequent.value[0], known_levels, own, back, pairs_of(w, first))
        if "levels" in part.schema.names:
            before = np.frombuffer(b"".join(part.column("levels").to_pylist()), np.uint8)
            ends = np.concatenate([first[1:], [len(w)]])
            before = np.concatenate([before[2 * a : 2 * b].reshape(2, -1) for a, b in zip(first, ends, strict=True)], axis=1)
            word, pair = np.maximum(word, before[0]), np.maximum(pair, before[1])
        return w, first, own, back, word, pair

    def collect_levels(shared):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for part in pieces(batches):
                w, first, *_, word, pair = levels(shared, part)
                both = np.stack([word, pair])
                ends = np.concatenate([first[1:], [len(w)]])
                found = pa.array([both[:, a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), found], ["doc_id", "text", "held_out", "row", "levels"])

        return run

    def score(shared):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for part in pieces(batches):
                w, first, words_here, back, word, pair = levels(shared, part)
                p = probabilities(word, pair, first, n_texts, n_train, n_words, prior)
                own = looked_up(words_here.view(np.int64), *frequent.value)
                known = np.where(own > 0, np.log10(own + ALPHA) - unit, 0.0)[back]
                own = own[back]
                # words outside the table meet their counts in the join below
                odd = np.flatnonzero(own == 0)
                marks = np.searchsorted(odd, np.concatenate([first, [len(w)]])).astype(np.int32)
                odd_words = pa.ListArray.from_arrays(pa.array(marks), pa.array(w[odd].view(np.int64)))
                sizes = np.diff(np.concatenate([first, [len(w)]]))
                sums = [pa.array(np.add.reduceat(x, first)) for x in ((own > 0).astype(np.int64), known, np.log10(p))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(sizes), *sums, odd_words], ["doc_id", "held_out", "row", "n_tokens", "known", "base", "score", "odd"])

        return run

    keyed = rows.withColumn("row", F.xxhash64("doc_id", "text", F.length("text"))).select("doc_id", "text", "held_out", "row")
    scored = f"doc_id {kind}, held_out boolean, row bigint, n_tokens bigint, known bigint, base double, score double, odd array<bigint>"
    shared = None
    for part in parts_of(bits, shards, part_mb):
        if shared is not None:  # a part before this one
            keyed = written(keyed.mapInArrow(collect_levels(shared), f"doc_id {kind}, text string, held_out boolean, row bigint, levels binary"))
            shared.unpersist()
        shared = context.broadcast((part.bits, part.at, part.level(top[0].view(np.uint64))))
    main = written(keyed.mapInArrow(score(shared), scored))
    met = main.select("row", F.explode("odd").alias("h")).join(words, "h", "left")
    c = F.coalesce("c", F.lit(0))
    # rows that repeat a document come several times on both sides of the sum; ``copies`` evens that out
    sums = met.groupBy("row").agg(F.sum(F.log10(c + ALPHA) - float(unit)).alias("more"), F.count_if(c > 0).alias("more_known"))
    copies = main.groupBy("row").agg(F.count(F.lit(1)).alias("copies"))
    out = main.join(sums.join(copies, "row"), "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce(F.expr("more_known div copies"), F.lit(0))).alias("n_known"), F.lit(n_train).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("more") / F.col("copies"), F.lit(0.0))).alias("base_score"), "score",
    )
