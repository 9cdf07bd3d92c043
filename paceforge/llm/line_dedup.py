"""Line deduplication by an exact set-similarity join, native DataFrame operations only.

A line is the set of its words. Lines x and y match if |x & y| / |x | y| >= t. A line is
removed if it matches an earlier line (by document id, then line number), kept or not.

1. Words are ordered by rarity. A table of word counts by hash bucket (all words of all
   lines, a fixed number of buckets) gives each word a rank; ties go by hash. Any fixed
   order is exact, a rarer-first order makes the lists below short.
2. Lines with the same set of words fold into their first one; the others match it.
3. Most of a group of near copies is settled against one earlier line: sets that share
   the smallest or the largest hash of all their words, or the smallest of their rare
   words, meet the first line that has it, and only that one.
4. Two sets that match share at least k = min(2, ceil(t |x|)) words, x the smaller one, among
   their first |x| - ceil(t |x|) + k words (prefix filter). Sets so short that only an equal
   one matches (under 4 words at t = 0.8) are done. Lines not settled yet meet all earlier sets
   there that are near in size: sizes fall in classes a factor of 1 / t wide, and a list holds
   one word's lines of one class, with lines of the class below as guests. As a guest's partners
   are larger, it needs a shorter prefix. Pairs must pass the length filter, with the positions of the shared word the
   positional filter, a bound on the words that only one of them has, from 96-bit parity
   signatures, and meet on k words.
5. The words of both lines of a pair that is left are compared (verification).

Stage 3 changes no result: it only spares stage 4 the pairs within a group, whose number
grows with the square of the group. A word that occurs once in all lines has no list.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceforge.llm.common import checkpoint, id_and_text, remove_folder, scratch_folder, written

BUCKETS, PLACES, PAGE = 1 << 22, 1 << 22, 1 << 12
SHARED = 2


def plain(text: Column) -> Column:
    """Lower case, with blanks for the other ASCII white space within a line."""
    out, any_other = F.lower(text), F.lit(False)
    for c in "\t\r\f\x0b":  # to look for one is much cheaper than to replace none
        out, any_other = F.replace(out, F.lit(c), F.lit(" ")), any_other | F.contains(text, F.lit(c))
    return F.when(any_other, out).otherwise(F.lower(text))


def word_set(line: Column) -> Column:
    """Distinct words of a plain line."""
    return F.array_distinct(F.array_remove(F.split(line, " "), ""))


def all_lines(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def byte_table(cells: DataFrame, size: int) -> bytes:
    """``size`` bytes from (i, v): v (0..127) at place i, 0 elsewhere. The driver gets at most ``size`` cells at any size of the input."""
    entry = ((F.col("i") % PAGE) * 256 + F.col("v")).cast("bigint")
    pages = cells.select(F.floor(F.col("i") / PAGE).cast("int").alias("page"), entry.alias("entry"))
    pages = pages.groupBy("page").agg(F.unhex(F.array_join(F.transform(F.collect_set("entry"), lambda e: F.lpad(F.hex(e), 6, "0")), "")).alias("entries"))
    table = np.zeros(size, np.uint8)
    for r in pages.collect():
        e = np.frombuffer(bytes(r["entries"]), np.uint8).reshape(-1, 3).astype(np.int64)
        table[r["page"] * PAGE + e[:, 0] * 256 + e[:, 1]] = e[:, 2]
    return table.tobytes()


def constant(spark: SparkSession, table: bytes) -> Column:
    """A table of bytes as a scalar read from the shared folder, so that no plan spells it out."""
    return checkpoint(spark.createDataFrame([(table,)], "t binary")).scalar()


def look_up(table: Column, size: int, h: Column) -> Column:
    return F.ascii(F.substring(table, (h.bitwiseAND(F.lit(size - 1)) + 1).cast("int"), F.lit(1)))  # size: a power of two


def rarity(docs: DataFrame) -> Column:
    """Rank (0..127, three steps an octave; 0: the bucket's only word occurs once) by the number of a hash bucket's words."""
    lines = docs.where("doc_id is not null").select(F.explode(F.split(plain(F.col("text")), "\n")).alias("line"))
    words = lines.select(F.explode(F.split("line", " ")).alias("w")).where("w <> ''")
    counted = words.groupBy(F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).alias("i")).agg(F.count(F.lit(1)).alias("n"))
    # a literal, as lambdas take no subquery; one plan holds it
    return F.lit(byte_table(counted.select("i", F.least(F.floor(3 * F.log2("n")), F.lit(127)).alias("v")).where("v > 0"), BUCKETS))


def _at_least(t: float, n: Column) -> Column:
    return F.ceil(F.lit(t) * n - F.lit(1e-9))


def _earlier(a: str, b: str) -> Column:
    return (F.col(f"doc_id_{a}") < F.col(f"doc_id_{b}")) | ((F.col(f"doc_id_{a}") == F.col(f"doc_id_{b}")) & (F.col(f"line_no_{a}") < F.col(f"line_no_{b}")))


def _can_match(t: float) -> Column:
    """Length filter and signature bound of a pair with suffixes _a and _b."""
    need = _at_least(t / (1 + t), F.col("size_a") + F.col("size_b"))
    return (F.col("size_a") >= _at_least(t, F.col("size_b"))) & (F.col("size_b") >= _at_least(t, F.col("size_a"))) & (_differing() <= F.col("size_a") + F.col("size_b") - 2 * need)


def _differing() -> Column:
    """Bits of the signatures of a pair that differ: at most the words that only one of the two has."""
    more = F.col("more_a").bitwiseXOR(F.col("more_b")).cast("bigint").bitwiseAND(F.lit(2**32 - 1))  # bit_count would extend the sign
    return F.bit_count(F.col("sig_a").bitwiseXOR(F.col("sig_b"))) + F.bit_count(more)


def verified(docs: DataFrame, pairs: DataFrame, t: float, folder: str) -> DataFrame:
    """(doc_id, line_no) of the later lines of pairs whose words match. Only lines in a pair are fetched from the documents."""
    ids = pairs.select(F.explode(F.array(*(F.struct(F.col(f"doc_id_{s}").alias("doc_id"), F.col(f"line_no_{s}").alias("line_no")) for s in "ab"))).alias("p")).select("p.*").distinct()
    place = F.xxhash64("doc_id", "line_no")
    wanted = byte_table(ids.select(F.pmod(place, F.lit(PLACES)).alias("i"), F.lit(1).alias("v")), PLACES)
    lines = all_lines(docs).where(look_up(constant(ids.sparkSession, wanted), PLACES, place) == 1).join(ids, ["doc_id", "line_no"], "left_semi")
    lines = written(lines.select("doc_id", "line_no", word_set(plain(F.col("line"))).alias("words")), folder)  # so that both sides split the documents once
    a, b = (lines.select(*(F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "line_no", "words"))) for s in "ab")
    both = pairs.join(a, ["doc_id_a", "line_no_a"]).join(b, ["doc_id_b", "line_no_b"])
    common = F.size(F.array_intersect("words_a", "words_b"))
    match = common >= _at_least(t / (1 + t), F.size("words_a") + F.size("words_b"))
    return both.where(match).select(F.col("doc_id_b").alias("doc_id"), F.col("line_no_b").alias("line_no")).distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, min_words: int = 1) -> DataFrame:
    """(doc_id, line_no, equal): lines that match an earlier one; ``equal`` says that their sets of words are the same.

    Lines of fewer than ``min_words`` different words are left alone, by default those without any.
    Null texts are empty; rows with a null id are left alone. Rows that repeat an id are one
    document: their equal line numbers are not earlier than each other. Similar lines are
    compared by their words; sets are folded by two 64-bit hashes of their words' 64-bit hashes.
    """
    t, docs = similarity, id_and_text(docs, id_col, text_col)
    folder = scratch_folder(docs.sparkSession)
    ranks, blank = rarity(docs), F.xxhash64(F.lit(""))
    hashes = F.array_distinct(F.array_remove(F.transform(F.split("line", " "), lambda w: F.xxhash64(w)), blank))
    lines = all_lines(docs.withColumn("text", plain(F.col("text")))).select("doc_id", "line_no", hashes.alias("h"))
    # a word's key: its rank, then 55 bits of its hash
    key = lambda h: F.shiftleft(look_up(ranks, BUCKETS, h).cast("bigint"), 55).bitwiseOR(F.shiftrightunsigned(h, 9))
    keyed = lines.select("doc_id", "line_no", F.size("h").alias("size"), F.sort_array("h").alias("h"), F.sort_array(F.transform("h", key)).alias("keys"))
    shared = lambda n: F.least(F.lit(SHARED), _at_least(t, n))  # noqa: E731  # never falls as n grows
    held = (F.col("size") - _at_least(t, F.col("size")) + shared(F.col("size"))).cast("int")

    def parity(some, kind: str, bits: int) -> Column:
        bit = lambda k: F.call_function("shiftleft", F.lit(1).cast(kind), k.bitwiseAND(F.lit(bits - 1)).cast("int"))
        return F.aggregate(F.filter("h", some), F.lit(0).cast(kind), lambda s, k: s.bitwiseXOR(bit(k)))

    keyed = keyed.select(
        "doc_id", "line_no", "size", F.xxhash64("h").alias("d1"), F.xxhash64(F.lit(1), F.col("h")).alias("d2"), F.array_min("h").alias("low"), F.array_max("h").alias("high"),
        parity(lambda k: k > 0, "bigint", 64).alias("sig"), parity(lambda k: k <= 0, "int", 32).alias("more"),
        # words of rank 0, the first ones, are left out; 31 bits of a key are enough for a list
        F.transform(F.filter(F.slice("keys", F.lit(1), held), lambda k: k >= F.lit(1 << 55)), lambda k: k.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")).alias("prefix"), held.alias("held"),
    )
    facts = ["doc_id", "line_no", "size", "sig", "more"]
    keyed = written(keyed, folder).where(F.col("size") >= min_words)  # every line is split and hashed once: a filter above it would do so again
    folded = keyed.groupBy("d1", "d2").agg(F.min(F.struct(*facts, "low", "high", "prefix", "held")).alias("first"), F.count(F.lit(1)).alias("n"))
    sets = written(folded, folder)
    firsts = sets.where("n > 1").select("d1", "d2", F.col("first.doc_id").alias("doc_id_a"), F.col("first.line_no").alias("line_no_a"))
    again = keyed.select(F.col("doc_id").alias("doc_id_b"), F.col("line_no").alias("line_no_b"), "d1", "d2").join(firsts, ["d1", "d2"]).where(_earlier("a", "b"))
    equal = again.select(F.col("doc_id_b").alias("doc_id"), F.col("line_no_b").alias("line_no"), F.lit(True).alias("equal"))

    # a shorter set matches no other one: all its words are needed, and any more are too many
    sets = sets.select("first.*").where((_at_least(t, F.col("size")) < F.col("size")) | (_at_least(t, F.col("size") + 1) <= F.col("size")))
    rare = F.array_min(F.transform("prefix", lambda x: F.xxhash64(x)))
    grouped = sets.select(*facts, F.explode(F.array("low", "high", rare)).alias("m")).where("m is not null")
    lead = grouped.groupBy("m").agg(F.min(F.struct(*facts)).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    lead = lead.select("m", *(F.col(f"f.{c}").alias(f"{c}_a") for c in facts))
    member = grouped.select("m", *(F.col(c).alias(f"{c}_b") for c in facts))
    led = member.join(lead, "m").where(_earlier("a", "b") & _can_match(t)).select("doc_id_a", "line_no_a", "doc_id_b", "line_no_b").distinct()
    settled = written(verified(docs, written(led, folder), t, folder), folder)

    flagged = sets.join(settled.withColumn("settled", F.lit(True)), ["doc_id", "line_no"], "left")
    # matching sets are of one class or of neighbouring ones: a class spans a little more than the factor 1 / t
    size, width = F.col("size"), max(-math.log(t), 0.01) * (1 + 1e-6)
    group = F.floor(F.log(size.cast("double")) / width)
    places = []
    for guest in (False, True):  # in its own class, which has smaller guests, and as the smaller set in the next one
        least = F.exp((group + 1) * width) * (1 - 1e-9) if guest else t * size  # a partner's size there
        longest = size - _at_least(t / (1 + t), size + least) + shared(size) - F.col("skipped")
        places.append(F.struct(F.lit(int(guest)).alias("guest"), F.greatest(longest, F.lit(0)).cast("int").alias("longest")))
    flagged = flagged.select(*facts, F.col("settled").isNull().alias("open"), (F.col("held") - F.size("prefix")).alias("skipped"), "prefix")
    posts = flagged.select(*facts, "open", "skipped", "prefix", group.alias("group"), F.inline(F.array(*places)))
    posts = posts.select(*facts, "open", "skipped", "group", "guest", F.posexplode(F.slice("prefix", F.lit(1), F.col("longest"))).alias("i", "word"))
    # size (31 bits), position (30 bits) and flags in one number, as there are many of these rows to shuffle
    packed = F.shiftleft(size.cast("bigint"), 32).bitwiseOR((F.col("skipped") + F.col("i")).cast("bigint") * 4).bitwiseOR(F.col("guest").cast("bigint") * 2).bitwiseOR(F.col("open").cast("bigint"))
    # a list's key mixes word and class; a list of two words costs some pairs more and changes no result
    posts = posts.select(F.hash("word", F.col("group") + F.col("guest")).alias("key"), "doc_id", "line_no", "sig", "more", packed.alias("facts"))

    a, b = (posts.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "line_no", "sig", "more", "facts"))) for s in "ab")
    # taken apart after the join; the flag is weighed with the other side's size, as a filter on one side alone would part the two sides' shuffles
    unpacked = {}
    for s in "ab":
        f = F.col(f"facts_{s}")
        unpacked |= {f"size_{s}": F.shiftright(f, 32).cast("int"), f"pos_{s}": F.shiftright(f.bitwiseAND(F.lit(2**32 - 1)), 2).cast("int")}
    is_open = F.col("facts_b").bitwiseAND(F.lit(1)) * F.shiftright("facts_a", 32) > 0
    not_guests = F.col("facts_a").bitwiseAND(F.col("facts_b")).bitwiseAND(F.lit(2)) == 0  # those meet in their own class
    # the signature bound in its cheapest form, which few pairs of a list pass
    alike = _differing() <= (F.shiftright("facts_a", 32) + F.shiftright("facts_b", 32)) * ((1 - t) / (1 + t)) + 1e-6
    rest = lambda s: F.col(f"size_{s}") - F.col(f"pos_{s}") - 1
    need = _at_least(t / (1 + t), F.col("size_a") + F.col("size_b"))
    positional = F.least("pos_a", "pos_b") + 1 + F.least(rest("a"), rest("b")) >= need
    # the first k shared words are among the first size - need + k words of either set
    for s in "ab":
        positional &= F.col(f"pos_{s}") < F.col(f"size_{s}") - need + shared(F.least("size_a", "size_b"))
    met = a.join(b, "key").where(_earlier("a", "b") & not_guests & alike & is_open).withColumns(unpacked).where(_can_match(t) & positional)
    pair = ["doc_id_a", "line_no_a", "doc_id_b", "line_no_b"]
    pairs = written(met.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"), F.first(shared(F.least("size_a", "size_b"))).alias("shared")).where("n >= shared").select(*pair), folder)
    similar = settled.unionByName(verified(docs, pairs, t, folder)).withColumn("equal", F.lit(False))
    removed = written(equal.unionByName(similar))
    remove_folder(docs.sparkSession, folder)
    return removed


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs``, all columns, with matching later lines cut from the text; a text that loses none stays as it is, null too."""
    cut = removed_lines(docs, id_col, text_col, **kw).groupBy("doc_id").agg(F.collect_set("line_no").alias("cut"))  # at most a document's lines
    one = docs.select(F.struct(*docs.columns).alias("row"))  # whole rows, so that no name can clash
    text = F.col(f"row.`{text_col}`")
    left = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("cut", i))
    text = F.when(F.col("cut").isNull(), text).otherwise(F.array_join(left, "\n"))
    joined = one.join(cut, F.col(f"row.`{id_col}`") == F.col("doc_id"), "left")
    return joined.select(*((text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row per document with an id: doc_id, n_lines, n_equal, n_similar, removed (sorted line numbers). Repeated ids are one document."""
    cut = removed_lines(docs, id_col, text_col, **kw).distinct()
    cut = cut.groupBy("doc_id").agg(F.count_if("equal").alias("n_equal"), F.count_if(~F.col("equal")).alias("n_similar"), F.sort_array(F.collect_list("line_no")).alias("removed"))
    base = id_and_text(docs, id_col, text_col).where("doc_id is not null").groupBy("doc_id").agg(F.max(F.size(F.split("text", "\n"))).cast("bigint").alias("n_lines"))
    return base.join(cut, "doc_id", "left").select(
        "doc_id", "n_lines", F.coalesce("n_equal", F.lit(0).cast("bigint")).alias("n_equal"), F.coalesce("n_similar", F.lit(0).cast("bigint")).alias("n_similar"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )
