"""Phrase collocations from a weighted de Bruijn graph of words.

Texts are cut into pieces, pieces into words. Nodes of the graph are runs of ``LONGEST - 1``
words, an edge is a run of ``LONGEST`` words that joins the node of its first words with that of its
last, weighted by how often it occurs.

1. What can't be part of a candidate stays out: a phrase is at most as frequent as the words,
   pairs, and runs of three and four words in it, and each of its words is in a frequent pair.
   Three passes count those in slots of hashed tables of fixed size; each task sends what its slots hold once. Slots under ``min_count``
   break the runs of words. Keys that share a slot cost work and change no result, as every
   count is taken exactly later.
2. Tasks, few and large ones, count edges, and where the walk through the graph ends (at the end of a piece or a break)
   the "tails", its last 1 to 4 words, over all their chunks; Spark adds them up.
3. Unary paths are compacted: where a node has one edge in and one out, of equal weight and
   without a tail, its two edges become parts of one path, by pointers that double each round. What a
   passage of a hundred words needs is one row then and not 96.
4. Counts of shorter phrases follow from the flow of the nodes: what leaves a node is the sum of
   its edges, and its occurrences at the end of a piece are its tails. The same step from
   runs of k + 1 words to those of k words gives all shorter counts.
5. Candidates look their parts up, the lowest cut is kept, and what lies inside a longer candidate
   of the same frequency is dropped. Products are decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceforge.llm.common import LOWER, checkpoint, written

LONGEST = 5
SLOTS = 1 << 26
BLOCK = 1 << 16
CHUNK_BYTES = 8 << 20
HELD_ROWS = 1 << 20
WAVES, TOGETHER = 2, 8
SALTS = 64
MEMBER = 0x5BF03635  # tag of the slots of words that are in a frequent pair

_PIECE_END = np.zeros(256, bool)
_PIECE_END[[*b".,;:!?", 10, 11, 12, 13]] = True
_BREAK = _PIECE_END.copy()
_BREAK[[9, 32]] = True


def passes(table: bytes, slots: np.ndarray) -> np.ndarray:
    return (np.frombuffer(table, np.uint8)[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)


class Chunk:
    """Words of some texts of one language as codes, with the number of the piece that each is in."""

    def __init__(self, lang: bytes, texts: list[bytes]):
        import pyarrow as pa
        import xxhash

        raw = np.frombuffer(b"\n".join([*texts, b""]).translate(LOWER), np.uint8)
        blank = _BREAK[raw]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], blank]).view(np.int8)))  # the last byte is a break
        first, last = edges[::2], edges[1::2]
        offsets = pa.array(np.concatenate([[0], np.cumsum(last - first)]), pa.int64())
        coded = pa.Array.from_buffers(pa.large_binary(), len(first), [None, offsets.buffers()[1], pa.py_buffer(raw[~blank].tobytes())]).dictionary_encode()
        self.words, self.codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.pieces = np.cumsum(_PIECE_END[raw])[first]
        key = lang + b"\t"
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(key + w) for w in self.words.to_pylist()), np.uint64, len(self.words))

    def slots(self, at: np.ndarray, k: int, tag: int = 0) -> np.ndarray:
        """Slots of the runs of k words that start at the places; another tag gives other slots."""
        h = self.hashes[self.codes[at]] ^ np.uint64(tag)
        for j in range(1, k):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + self.hashes[self.codes[at + j]]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(38)).astype(np.int64)  # the upper 26 bits

    def reach(self, tables: list[bytes]) -> list[np.ndarray]:
        """For k of 1 to 5, where a run of k words starts in which all shorter runs pass the tables (words, pairs, longer ones) given so far."""
        out: list[np.ndarray] = []
        for k in range(1, LONGEST + 1):
            if k == 1:
                ok = np.ones(len(self.codes), bool)
            else:
                ok = np.zeros(len(self.codes), bool)
                ok[:-1] = out[-1][:-1] & out[-1][1:] & (self.pieces[1:] == self.pieces[:-1])
            if k < LONGEST and len(tables) >= min(k, 3):
                at = np.flatnonzero(ok)
                ok[at] = passes(tables[min(k, 3) - 1], self.slots(at, k))
            out.append(ok)
        return out

    def phrases(self, columns: list[np.ndarray]):
        """Words of the columns, joined row by row."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(columns) == 1:
            return self.words.take(pa.array(columns[0]))
        return pc.binary_join_element_wise(*(self.words.take(pa.array(c)) for c in columns), pa.scalar(b" ", pa.large_binary()))

    def counted(self, at: np.ndarray, k: int):
        """(distinct runs of k words that start at the places, how often each does)."""
        import pyarrow as pa

        group = self.codes[at]
        for j in range(1, k):  # exact: pairs of (run so far, next word), numbered anew each time
            _, group = np.unique(group * len(self.words) + self.codes[at + j], return_inverse=True)
        _, first, n = np.unique(group, return_index=True, return_counts=True)
        return self.phrases([self.codes[at[first] + j] for j in range(k)]), pa.array(n, pa.int64())


def paired(starts: np.ndarray) -> np.ndarray:
    """Words in a pair, from where pairs start."""
    out = starts.copy()
    out[1:] |= starts[:-1]
    return out


def chunks_of(batches: Iterator, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[bytes, Chunk]]:
    """Chunks of the rows (lang, text), one for each language at a time."""
    held: dict[bytes, list[bytes]] = {}
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= chunk_bytes:
                    yield from ((k, Chunk(k, v)) for k, v in held.items())
                    held, size = {}, 0
    yield from ((k, Chunk(k, v)) for k, v in held.items())


def slot_counts(texts: DataFrame, tables: list[bytes]) -> DataFrame:
    """Of each task, the counts (255 at most) in the slots that it has met, by block; with no table yet, also its words of each language."""
    sent = texts.sparkSession.sparkContext.broadcast(tables)  # each of a fixed size

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter, total, lengths = np.zeros(SLOTS, np.uint8), {}, ((1,), (2,), (0, 3, 4))[len(sent.value)]  # 0: words of pairs that pass
        for lang, chunk in chunks_of(batches):
            starts = chunk.reach(sent.value)
            for k in lengths:
                seen = chunk.slots(np.flatnonzero(starts[k - 1]), k) if k else chunk.slots(np.flatnonzero(paired(starts[1])), 1, MEMBER)
                at, n = np.unique(seen, return_counts=True)
                counter[at] = np.minimum(counter[at] + n, 255)
            total[lang] = total.get(lang, 0) + len(chunk.codes)
        met = np.flatnonzero(counter)
        cuts = np.searchsorted(met, np.arange(0, SLOTS + 1, BLOCK))
        rows = [(-1, lang.decode("utf-8", "replace"), n, None, None) for lang, n in total.items()] if not sent.value else []
        for block in np.flatnonzero(np.diff(cuts)).tolist():
            own = met[cuts[block] : cuts[block + 1]]
            rows.append((block, None, None, (own % BLOCK).astype(np.uint16).tobytes(), counter[own].tobytes()))
        for at in range(0, len(rows), 128):
            cols = zip(*rows[at : at + 128], strict=True)
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["block", "lang", "n", "slots", "counts"])

    return texts.mapInArrow(run, "block int, lang string, n bigint, slots binary, counts binary")


def bit_table(counts: DataFrame, min_count: int) -> bytes:
    """A bit for each slot with at least ``min_count``. Blocks are added up in tasks, row by row; the driver gets the table's fixed size."""
    least = min(min_count, 255)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def row(block, total):
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

        now, total = None, None
        for batch in batches:
            for block, slots, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if block != now:
                    if now is not None:
                        yield row(now, total)
                    now, total = block, np.zeros(BLOCK, np.int64)
                total[np.frombuffer(slots, np.uint16)] += np.frombuffer(counts, np.uint8)
        if now is not None:
            yield row(now, total)

    dealt = counts.where("block >= 0").select("block", "slots", "counts").repartition("block").sortWithinPartitions("block")
    out = bytearray(SLOTS // 8)
    for r in dealt.mapInArrow(run, "block int, bits binary").toLocalIterator():
        out[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = r["bits"]
    return bytes(out)


class Held:
    """Counts of runs of words over the chunks of a task, by language and length, so that a task makes one row for each."""

    def __init__(self):
        self.tables: dict[tuple[bytes, int], list] = {}
        self.rows = 0

    def add(self, lang: bytes, k: int, grams, n) -> None:
        import pyarrow as pa

        self.tables.setdefault((lang, k), []).append(pa.table({"gram": grams, "n_sum": n}))
        self.rows += len(grams)

    def merge(self) -> None:
        import pyarrow as pa

        for key, parts in self.tables.items():
            if len(parts) > 1:
                one = pa.concat_tables([p.rename_columns(["gram", "n"]) for p in parts])
                self.tables[key] = [one.group_by("gram", use_threads=False).aggregate([("n", "sum")])]
        self.rows = sum(len(p) for parts in self.tables.values() for p in parts)

    def rows_out(self) -> Iterator:
        """All that is held, as record batches; nothing is held then."""
        import pyarrow as pa

        self.merge()
        for (lang, k), parts in self.tables.items():
            for part in parts[0].select(["gram", "n_sum"]).to_batches(max_chunksize=16384):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang.decode("utf-8", "replace")] * len(part), pa.string()), pa.array([k] * len(part), pa.int32()), part.column(0).cast(pa.large_string()).cast(pa.string()), part.column(1)],
                    names=["lang", "k", "gram", "n"],
                )
        self.tables, self.rows = {}, 0


def in_fewer_tasks(texts: DataFrame, together: int = TOGETHER) -> DataFrame:
    """The same rows in ``WAVES`` tasks a core, or in more where a task would get over ``together`` of the scan's partitions.

    A frequent run is a row of every task that meets it, so rows grow with the number of tasks times that of the
    frequent runs. What a task holds is bounded whatever it reads.
    """
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts.coalesce(max(WAVES * cores, -(-texts.rdd.getNumPartitions() // together)))


def counted_grams(texts: DataFrame, tables: list[bytes], chunk_bytes: int = CHUNK_BYTES, held_rows: int = HELD_ROWS) -> DataFrame:
    """Edges (k = 5) and tails (k < 5) of each task with their counts; a task of very many runs gives some of them more than once."""
    sent = texts.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator) -> Iterator:
        held = Held()
        for lang, chunk in chunks_of(batches, chunk_bytes):
            if not len(chunk.codes):
                continue
            starts = chunk.reach(sent.value)
            reach = np.sum(starts, axis=0)
            alone = np.flatnonzero(reach == 1)  # a word that is in no frequent pair anywhere is part of no candidate
            reach[alone[~passes(sent.value[2], chunk.slots(alone, 1, MEMBER))]] = 0
            for k in range(1, LONGEST + 1):
                at = np.flatnonzero(reach == k)
                if len(at):
                    held.add(lang, k, *chunk.counted(at, k))
            if held.rows > held_rows:
                held.merge()
                if held.rows > held_rows // 2:  # what is merged stays only if it leaves room for more
                    yield from held.rows_out()
        yield from held.rows_out()

    return texts.mapInArrow(run, "lang string, k int, gram string, n bigint")


def gram_table(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 100) -> tuple[DataFrame, DataFrame]:
    """((lang, n): all words of a language; (lang, k, gram, n): edges and tails between possibly frequent runs)."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).cast("binary").alias("lang"), F.col(text_col).cast("binary").alias("text")).where("length(text) > 0")
    first = written(slot_counts(texts, []))
    tables = [bit_table(first, min_count)]
    for _ in range(2):
        tables.append(bit_table(slot_counts(texts, tables), min_count))
    totals = first.where("block < 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return totals, written(counted_grams(in_fewer_tasks(texts), tables).groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")))


def compact_paths(grams: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(lang, words, weight): paths that hold every edge once; inner nodes have one edge in, one out, equal weights and no tail.

    ``words`` is an array; a path of m words holds m - 4 edges. Every edge that starts in an
    inner node points at the one before it; pointers double in each round (a written table)
    until they reach the first edge of the path, whose distance orders the rest. Circles of inner
    nodes have no first edge; their edges stay paths of their own. A path is one row, as long as the
    passage it stands for.
    """
    edges = grams.where(F.col("k") == LONGEST).select("lang", "gram", "n", F.substring_index("gram", " ", LONGEST - 1).alias("source"), F.substring_index("gram", " ", 1 - LONGEST).alias("target"))
    tails = grams.where(F.col("k") == LONGEST - 1).select("lang", F.col("gram").alias("node")).distinct()
    out = edges.groupBy("lang", F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("outs"), F.max("n").alias("out_n"), F.max("gram").alias("after"))
    into = edges.groupBy("lang", F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("ins"), F.max("n").alias("in_n"), F.max("gram").alias("before"))
    inner = out.where("outs = 1").join(into.where("ins = 1"), ["lang", "node"]).where("out_n = in_n").join(tails, ["lang", "node"], "left_anti")
    steps = checkpoint(inner.select("lang", "before", F.col("after").alias("gram"), "out_n"))  # at most one for each edge, either way
    first = steps.select("lang", F.col("before").alias("gram"), "out_n").join(steps.select("lang", "gram"), ["lang", "gram"], "left_anti")
    live = steps.select("lang", "gram", F.col("before").alias("to"), F.lit(1).alias("far"), "out_n").unionByName(first.select("lang", "gram", F.col("gram").alias("to"), F.lit(0).alias("far"), "out_n"))
    live, last = checkpoint(live.withColumn("done", F.col("far") == 0)), None
    for _ in range(max_rounds):
        ahead = live.select("lang", F.col("gram").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"), F.col("done").alias("there"))
        moved = live.where("not done").join(ahead, ["lang", "to"]).select("lang", "gram", F.col("next").alias("to"), (F.col("far") + F.col("more")).alias("far"), "out_n", F.col("there").alias("done"))
        live = checkpoint(live.where("done").unionByName(moved))
        left = live.where("not done").count()
        if not left or left == last:  # in each round some edge of every open path arrives, so what stays is circles
            break
        last = left
    arrived = live.where("done").groupBy("lang", "to").agg(F.sort_array(F.collect_list(F.struct("far", "gram"))).alias("edges"), F.max("out_n").alias("weight"))
    words = F.concat(F.split(F.col("to"), " "), F.transform(F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 1, F.lit(0))), lambda e: F.substring_index(e["gram"], " ", -1)))
    alone = edges.join(live.where("done").select("lang", "gram"), ["lang", "gram"], "left_anti")
    return arrived.select("lang", words.alias("words"), "weight").unionByName(alone.select("lang", F.split("gram", " ").alias("words"), F.col("n").alias("weight")))


def phrase_counts(grams: DataFrame, paths: DataFrame, min_count: int = 100) -> DataFrame:
    """(lang, k, gram, n): exact counts of the phrases of 1 to 5 words with at least ``min_count`` occurrences."""
    place = F.explode(F.sequence(F.lit(1), F.size("words") - (LONGEST - 1)))
    level = paths.select("lang", "words", "weight", place.alias("at")).select("lang", F.array_join(F.slice("words", F.col("at"), F.lit(LONGEST)), " ").alias("gram"), F.col("weight").alias("n"))
    counts = None
    for k in range(LONGEST, 0, -1):
        if k < LONGEST:
            flow = level.select("lang", F.substring_index("gram", " ", k).alias("gram"), "n")
            level = flow.unionByName(grams.where(F.col("k") == k).select("lang", "gram", "n")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        level = checkpoint(level)
        own = level.where(F.col("n") >= min_count).select("lang", F.lit(k).alias("k"), "gram", "n")
        counts = own if counts is None else counts.unionByName(own)
    return counts


def rank_candidates(counts: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """Each language's first ``top`` phrases by their lowest cut."""
    words_of = lambda n: F.expr(f"substring_index(phrase, ' ', {n})")  # the first words, or the last ones where n is negative
    phrases = counts.where("k > 1").select("lang", "k", F.col("gram").alias("phrase"), F.col("n").alias("a"))
    longer = phrases.where("k > 2").select("lang", "phrase", "a", F.explode(F.array(words_of("k - 1"), words_of("1 - k"))).alias("inside"))
    covered = longer.select("lang", F.col("inside").alias("phrase"), "a").distinct()  # a longer one is never more frequent, so equal counts are enough
    kept = phrases.join(covered, ["lang", "phrase", "a"], "left_anti")
    cuts = kept.select("lang", "k", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"left": words_of("cut"), "right": words_of("cut - k")})
    part = lambda side, n: counts.select("lang", F.col("gram").alias(side), F.col("n").alias(n))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    cuts = cuts.withColumn("score", F.expr("(cast(1000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(n as decimal(38,0))) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0)))"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = lowest.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))


def mine_collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, top: int = 2000) -> DataFrame:
    """Each language's ``top`` phrases of 2 to 5 words: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; pieces end at ``.,;:!?`` and line ends, words at spaces and tabs. a, l and r
    count the phrase and both sides of its lowest-scoring cut, n all words of the language. Null and
    empty texts add nothing, a null language is ``und``; repeated rows count as often as they
    come; ties are ordered by a, then by the phrase's bytes. No phrase, no rows. Other
    columns are not read.
    """
    totals, grams = gram_table(docs, text_col, lang_col, min_count)
    return rank_candidates(written(phrase_counts(grams, compact_paths(grams), min_count)), totals, top)


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, [w for w in regexp_split_to_array(piece, '[ \t]+') if w <> ''] AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
counts AS (SELECT lang, k, gram, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS n FROM counts WHERE k = 1 GROUP BY lang),
phrases AS (SELECT lang, k, gram, n AS a, string_split(gram, ' ') AS w FROM counts WHERE k > 1 AND n >= 100),
covered AS (
  SELECT lang, array_to_string(w[1:k - 1], ' ') AS gram, a FROM phrases WHERE k > 2 UNION SELECT lang, array_to_string(w[2:k], ' '), a FROM phrases WHERE k > 2),
kept AS (SELECT * FROM phrases p WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.lang = p.lang AND c.gram = p.gram AND c.a = p.a)),
cuts AS (SELECT lang, k, gram, a, w, unnest(range(1, k)) AS cut FROM kept),
scored AS (
  SELECT c.lang, c.gram, c.a, c.cut, l.n AS l, r.n AS r, t.n AS n, (1000 * c.a::HUGEINT * t.n::HUGEINT) // (l.n::HUGEINT * r.n::HUGEINT) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.gram = array_to_string(w[1:cut], ' ') JOIN counts r ON r.lang = c.lang AND r.gram = array_to_string(w[cut + 1:c.k], ' ') JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) AS nr FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank FROM lowest WHERE nr = 1)
SELECT lang, rank, gram AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
