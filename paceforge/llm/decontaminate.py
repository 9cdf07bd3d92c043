"""Benchmark decontamination by template windows.

Numbers, units and names become typed placeholders, so that a question with other
values still has the template of the original. Windows of ``size`` canonical words are
hashed, once with placeholders and once without; windows of documents meet those of
benchmark benchmark items in a hash join. On each diagonal (document position minus item
position) the values in the placeholders must then be a consistent substitution: one
value of the item always stands for the same value of the document; two values of the
item may stand for the same one. Windows with an item value that stands for several do
not count, the others of the diagonal do.

A capitalised word is a name wherever it stands: at the start of a sentence it can't be
told from other words, and a placeholder with the same word on both sides costs nothing.
Where placeholders outnumber the other words of a window it is doubled, up to ``LONGER``
times, until it holds half a window of other words and two more for each doubling.

Before the join, document windows pass a bitmap of 2^22 bits (512 KB, whatever the size
of the benchmark); a fuller bitmap lets more rows through and loses none.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceforge.llm.common import checkpoint, id_and_text, map_rows

# fixed values: units that follow a number, and numbers written as words
UNITS = frozenset(
    "mm cm m km in inch inches ft feet foot yd yard yards mile miles mg g gram grams kg kilogram kilograms lb lbs pound pounds oz ton tons "
    "ml l liter liters litre litres s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "mph kmh km/h m/s hz khz mhz ghz w kw mw v a j kj cal kcal pa kpa bar c f k % percent degrees degree dollars dollar cents cent euros euro usd eur gbp".split()
)
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
_EDGE = " \t\n\r\"'`.,;:!?()[]{}<>*&#|/\\_=~“”‘’«»"
_NUMBER = re.compile(r"[+\-$€£]?\d[\d.,:/]*%?")
_NUM, _CAP, _UNIT = 1, 2, 8
_SLOT = {_NUM: 0x9E3779B97F4A7C10, _CAP: 0xC2B2AE3D27D4EB40, _UNIT: 0x165667B19E3779F0}
BITS, LONGER = 22, 2


class Canon(dict):
    """Memo of raw token -> hash of its bare lower-case form with flags in the low 4 bits; 0 for mere punctuation."""

    def __missing__(self, token: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 400_000:
            self.clear()
        bare = token.strip(_EDGE)
        value = 0
        if bare:
            low = bare.lower()
            value = (xxh64_intdigest(low.encode("utf-8", "surrogatepass"), 3) & ~15) or 16
            value |= _NUM * bool(_NUMBER.fullmatch(bare) or low in NUMBER_WORDS) | _UNIT * (low in UNITS)
            value |= _CAP * (len(bare) > 1 and bare[0].isupper() and bare[1:].islower())
        self[token] = value
        return value


def canonical(text: str, memo: Canon) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Bare words; hashes of the plain and of the template form; type of each word's slot (0: none)."""
    tokens = text.split()
    v = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
    real = v != 0
    if not real.all():
        tokens = [t for t, ok in zip(tokens, real.tolist(), strict=True) if ok]
        v = v[real]
    flags = (v & np.uint64(15)).astype(np.int64)
    plain = v & np.uint64(2**64 - 16)
    num = (flags & _NUM) > 0
    unit = ((flags & _UNIT) > 0) & np.concatenate([[False], num[:-1]]) if len(v) else num
    name = ((flags & _CAP) > 0) & ~num & ~unit
    slot = np.where(num, _NUM, np.where(unit, _UNIT, np.where(name, _CAP, 0)))
    template = plain.copy()
    for kind, h in _SLOT.items():
        template[slot == kind] = np.uint64(h)
    return tokens, plain, template, slot


def window_hashes(h: np.ndarray, size: int, seed: int) -> np.ndarray:
    n = len(h) - size + 1
    out = np.full(max(n, 0), np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
    for j in range(size if n > 0 else 0):
        out = (out ^ h[j : j + n]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return out


def dense_windows(template: np.ndarray, filled: np.ndarray, size: int, at: np.ndarray):
    """(hashes, starts, length) of longer template windows at the starts ``at``, whose windows of ``size`` hold too many placeholders."""
    for k in range(1, LONGER + 1):
        length = size << k
        at = at[at + length <= len(template)]
        if not len(at):
            return
        enough = length - (filled[at + length] - filled[at]) >= size // 2 + 2 * k
        here, at = at[enough], at[~enough]
        for part in np.array_split(here, len(here) // 65536 + 1):
            yield window_hashes(template[part[:, None] + np.arange(length)].T, length, length * 2 + 1)[0], part, length


def windows(text: str, sizes: Sequence[int], memo: Canon, bitmap: np.ndarray | None = None, full: int = 0):
    """(hash, size, position, length, template?, slot values) of a text's windows, those outside the bitmap left out.

    Template windows are given only where they hold a slot and at least as many other words;
    those of size ``full`` that hold fewer are longer, see ``dense_windows``.
    """
    tokens, plain, template, slot = canonical(text, memo)
    filled = np.concatenate([[0], np.cumsum(slot > 0)])
    for size in sizes:
        groups = []
        for form, h in enumerate((plain, template)):
            keys = window_hashes(h, size, size * 2 + form)
            at = np.arange(len(keys))
            if form and len(keys):
                held = filled[size:] - filled[:-size]
                ok = (held > 0) & (2 * held <= size)
                if size == full:
                    groups += [(*g, 1) for g in dense_windows(template, filled, size, np.flatnonzero(2 * held > size))]
                keys, at = keys[ok], at[ok]
            groups.append((keys, at, size, form))
        for keys, at, length, form in groups:
            if bitmap is not None and len(keys):
                short = keys >> np.uint64(64 - BITS)
                ok = (bitmap[(short >> np.uint64(3)).astype(np.int64)] >> (short & np.uint64(7)).astype(np.uint8)) & 1 > 0
                keys, at = keys[ok], at[ok]
            for key, i in zip(keys.view(np.int64).tolist(), at.tolist(), strict=True):
                values = [f"{slot[j]}{tokens[j].strip(_EDGE).lower()}" for j in range(i, i + length) if slot[j]] if form else []
                yield key, size, i, length, form, values


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 8,
    min_coverage: float = 0.5,
    small_benchmark: int = 200_000,
) -> DataFrame:
    """One row per document and item that share a window: doc_id, item_id, matched, item_windows, coverage, n_slots, template, contaminated.

    ``matched`` counts the item's windows found in the document, plainly or by a consistent
    substitution, alone or inside a longer one; ``coverage`` is their share and ``contaminated`` says that it reaches
    ``min_coverage``. ``template`` says that values of consistent slots differ somewhere, ``n_slots`` how many values are consistent. Items shorter than
    ``size`` words are one window of their own length; items and documents without words,
    null texts and null ids have no match. Repeated rows count once. Benchmarks of up to
    ``small_benchmark`` windows (counted) are broadcast, at about 100 bytes a row.
    """
    items = id_and_text(benchmark, item_col, item_text_col).withColumnRenamed("doc_id", "item_id").where("item_id is not null")
    kinds = dict(items.dtypes)

    def item_start():
        memo = Canon()

        def one(r):
            n = len(canonical(r["text"], memo)[0])
            own = min(size, n)
            for key, s, i, length, form, values in windows(r["text"], [own] if own else [], memo, full=size):
                yield key, r["item_id"], s, i, length, form, values, n - own + 1

        return one

    known = checkpoint(map_rows(items, f"hash bigint, item_id {kinds['item_id']}, size int, ipos int, length int, form int, ivalues array<string>, item_windows int", item_start).distinct())
    facts = known.agg(F.count(F.lit(1)).alias("n"), F.collect_set("size").alias("sizes")).first()  # at most ``size`` sizes
    sizes = sorted(facts["sizes"])
    short = known.select(F.shiftrightunsigned("hash", 64 - BITS).alias("b")).distinct().toArrow()  # at most 2^BITS numbers
    bitmap = np.zeros(2**BITS // 8, np.uint8)
    b = short.column("b").to_numpy().astype(np.int64)
    np.bitwise_or.at(bitmap, b >> 3, (1 << (b & 7)).astype(np.uint8))
    rows = id_and_text(docs, id_col, text_col).where("doc_id is not null")
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)
    kind = dict(rows.dtypes)["doc_id"]

    def doc_start():
        memo = Canon()
        return lambda r: ((key, r["doc_id"], i, values) for key, _, i, _, _, values in windows(r["text"], sizes, memo, shared.value, size))

    seen = map_rows(rows, f"hash bigint, doc_id {kind}, dpos int, dvalues array<string>", doc_start)
    met = seen.join(F.broadcast(known) if facts["n"] <= small_benchmark else known, "hash")
    met = met.withColumn("pairs", F.arrays_zip("ivalues", "dvalues")).withColumn("diagonal", F.col("dpos") - F.col("ipos"))
    # a diagonal has at most twice as many windows as the item
    found = F.struct("ipos", "length", "size", "form", "ivalues")
    diagonal = met.groupBy("doc_id", "item_id", "diagonal").agg(F.max("item_windows").alias("item_windows"), F.collect_set(found).alias("windows"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    # item values with several document values: those that follow themselves in order
    diagonal = diagonal.withColumn("values", F.sort_array("pairs.ivalues"))
    diagonal = diagonal.withColumn("uneven", F.filter("values", lambda v, i: v == F.get("values", i - 1)))
    even = F.filter("pairs", lambda p: ~F.array_contains("uneven", p["ivalues"]))
    counted = F.filter("windows", lambda x: (x["form"] == 0) | ~F.arrays_overlap(x["ivalues"], F.col("uneven")))
    places = F.array_distinct(F.flatten(F.transform(counted, lambda x: F.sequence(x["ipos"], x["ipos"] + x["length"] - x["size"]))))
    judged = diagonal.select("doc_id", "item_id", "item_windows", places.alias("found"), F.size(even).alias("slots"), F.exists(even, lambda p: p["ivalues"] != p["dvalues"]).alias("template"))
    out = judged.groupBy("doc_id", "item_id").agg(
        F.max("item_windows").alias("item_windows"), F.size(F.array_distinct(F.flatten(F.collect_set("found")))).alias("matched"),
        F.max("slots").cast("bigint").alias("n_slots"), F.max("template").alias("template"),
    )
    share = F.col("matched") / F.col("item_windows")
    return out.where("matched > 0").select("doc_id", "item_id", "matched", "item_windows", share.alias("coverage"), "n_slots", "template", (share >= min_coverage).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs``, all columns, without those that hold a benchmark item; null ids stay."""
    gone = leaks(docs, benchmark, id_col, text_col, **kw).where("contaminated").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
