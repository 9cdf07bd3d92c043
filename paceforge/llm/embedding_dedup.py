"""Near-duplicate embeddings by randomised-rotation binary codes with stored correction factors.

1. Equal vectors of a label fold into one class with a weight, so that copies are never paired.
2. Every class gets a code: its unit vector is padded with zeros, turned by a random rotation
   (random signs and Hadamard transforms, three rounds) and cut to signs. Beside the code is
   stored its correction factor f, the inner product of the vector with its own code. With
   another vector q, <code, q> / f estimates the cosine without bias, and differs from it by
   more than ``bound`` * sqrt((1 - f^2) / (f^2 * (bits - 1))) with a chance that falls as
   exp(-c * bound^2).
3. Candidates meet in buckets: the place and sign of the largest coordinate under further
   random rotations, in several tables. How many rotations make a key follows from the number
   of vectors in the largest label (about one stranger for every two places), and how many
   tables from the wanted chance (``recall``) that a pair just at the threshold meets. So the
   work stays near n log n and the recall is the same at every size. Keys held by one class
   only go before any vector moves; large buckets are split into cells of bounded size, every
   two parts of a bucket meet in one cell.
4. Within a cell the other side is rounded to four bits a coordinate with a fixed dither;
   bit counts give the estimate, and pairs whose upper bound reaches the threshold are
   recomputed from the vectors in double precision. A pair that meets in several tables
   counts in the first. Cells report sums and spanning links, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceforge.llm.common import written
from paceforge.llm.components import connected_components

PAIRS_AT_ONCE = 1 << 17


def power_of_two(n: int) -> int:
    return 1 << max(1, (n - 1).bit_length())


def hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h / np.float32(math.sqrt(n))


def rotate(x: np.ndarray, seed: int, width: int) -> np.ndarray:
    """Rows padded with zeros to ``width`` (a power of two) and turned by the rotation number ``seed``; lengths stay."""
    rng, side = np.random.default_rng(seed), 1 << ((width.bit_length() - 1) // 2)
    left, right = hadamard(width // side), hadamard(side)
    out = np.zeros((len(x), width), np.float32)
    out[:, : x.shape[1]] = x
    for _ in range(3):
        out *= rng.choice(np.array([-1, 1], np.float32), width)
        out = (left @ out.reshape(-1, width // side, side) @ right).reshape(-1, width)
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, whatever their size."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def codes(u: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sign codes as 64-bit words, and the correction factors of unit vectors."""
    r = rotate(u, 0, bits)
    return np.packbits(r > 0, axis=1, bitorder="little").view(np.uint64), np.abs(r).sum(1) / math.sqrt(bits)


def planes(u: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors in four bits a coordinate: the four bit planes, lowest value, step, and the sum of coordinates."""
    r = rotate(u, 0, bits)
    low = r.min(1)
    step = np.maximum((r.max(1) - low) / 15, 1e-12)
    dither = np.random.default_rng(99).random(bits, np.float32)
    q = np.clip(np.floor((r - low[:, None]) / step[:, None] + dither), 0, 15).astype(np.uint8)
    bit = [np.packbits(q >> t & 1, axis=1, bitorder="little").view(np.uint64) for t in range(4)]
    return np.stack(bit, 1), low, step, r.sum(1)


def estimates(code: np.ndarray, factor: np.ndarray, query: tuple, bits: int) -> np.ndarray:
    """Row by row the unbiased estimate of the cosine of a coded vector with a rounded one."""
    plane, low, step, total = query
    hits = np.bitwise_count(plane & code[:, None, :]).sum(2, dtype=np.int64) @ np.array([1, 2, 4, 8])
    ones = np.bitwise_count(code).sum(1, dtype=np.int64)
    return (2 * (low * ones + step * hits) - total) / math.sqrt(bits) / factor


def half_width(factor: np.ndarray, bits: int, bound: float) -> np.ndarray:
    """Half the width of the confidence interval of an estimate."""
    return bound * np.sqrt(np.maximum(1 - factor**2, 0) / (factor**2 * (bits - 1)))


def table_plan(dim: int, rows: int, threshold: float, recall: float) -> tuple[list[int], int]:
    """(coordinates that each part of a key looks at, number of tables) for ``rows`` vectors in the largest label.

    The chance that a part agrees for a pair at the threshold is measured on random pairs
    of exactly that cosine, with a fixed seed.
    """
    width = power_of_two(dim)
    bits, full = max(1, math.ceil(math.log2(2 * max(rows, 1)))), width.bit_length()
    parts = [width] * (bits // full) + ([1 << (bits % full - 1)] if bits % full else [])
    rng = np.random.default_rng(1)
    a, b = unit(rng.standard_normal((4000, dim))), rng.standard_normal((4000, dim))
    b = unit(b - (a * b).sum(1, keepdims=True) * a) if dim > 1 else a
    b = threshold * a + math.sqrt(1 - threshold**2) * b if dim > 1 else a
    chance = 1.0
    for k in set(parts):
        x, y = rotate(a, 7, width)[:, :k], rotate(b, 7, width)[:, :k]
        chance *= max(1e-3, float((place(x) == place(y)).mean())) ** parts.count(k)
    return parts, 1 if chance >= recall else math.ceil(math.log(1 - recall) / math.log(1 - chance))


def place(r: np.ndarray) -> np.ndarray:
    """The largest coordinate and its sign."""
    at = np.abs(r).argmax(1)
    return 2 * at + (r[np.arange(len(r)), at] > 0)


def bucket_keys(u: np.ndarray, parts: list[int], tables: int) -> np.ndarray:
    """One key for each row and table."""
    width = power_of_two(u.shape[1])
    out = np.zeros((len(u), tables), np.int64)
    for t in range(tables):
        for p, k in enumerate(parts):
            out[:, t] = out[:, t] * (2 * width) + place(rotate(u, 1000 + t * len(parts) + p, width)[:, :k])
    return out


def _matrix(lists, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def encode(classes: DataFrame, plans: dict[int, tuple[list[int], int]], min_bits: int) -> DataFrame:
    """Adds code, factor and keys to the classes."""
    kind = dict(classes.dtypes)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                for at in range(0, part.num_rows, 4096):
                    rows = part.slice(at, 4096)
                    u = unit(_matrix(rows.column("vec"), dim))
                    code, factor = codes(u, max(min_bits, power_of_two(dim)))
                    keys = bucket_keys(u, *plans[dim])
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factor, pa.float64()), pa.array(list(keys), pa.list_(pa.int64()))],
                        names=[*rows.schema.names, "code", "factor", "keys"],
                    )

    return classes.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in kind.items()) + ", code binary, factor double, keys array<bigint>")


def compare_cells(members: DataFrame, label: str, threshold: float, bound: float, min_bits: int) -> DataFrame:
    """(node, links, root) of each cell: the weight of what a class links with there, and the class that spans its linked group."""

    def linked(rows, dim: int, first: np.ndarray, count: np.ndarray) -> Iterator:
        import pyarrow as pa

        bits = max(min_bits, power_of_two(dim))
        col = lambda c: rows.column(c).to_numpy()
        node, weight, factor, table = col("node"), col("weight"), col("factor"), col("table")
        keys = rows.column("keys").combine_chunks()
        keys = keys.flatten().to_numpy().reshape(len(keys), -1)
        u, code = unit(_matrix(rows.column("vec").combine_chunks(), dim)), np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint64).reshape(len(node), -1)
        query, wide = planes(u, bits), half_width(factor, bits, bound)
        links, root = np.zeros(len(node), np.int64), np.arange(len(node))
        ends, at = np.cumsum(count), 0
        while at < len(count):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            n = count[at:to]
            i = np.repeat(np.arange(at, to), n)
            j = np.repeat(first[at:to] - (np.cumsum(n) - n), n) + np.arange(len(i))
            may = estimates(code[j], factor[j], tuple(x[i] for x in query), bits) + wide[j] >= threshold
            i, j = i[may], j[may]
            yes = np.einsum("ij,ij->i", u[i], u[j]) >= threshold
            i, j = i[yes], j[yes]
            seen = ((keys[i] == keys[j]) & (np.arange(keys.shape[1]) < table[i][:, None])).any(1)
            i, j = i[~seen], j[~seen]
            links += np.bincount(i, weight[j], len(node)).astype(np.int64) + np.bincount(j, weight[i], len(node)).astype(np.int64)
            while len(i):
                low = np.minimum(root[i], root[j])
                before = root.copy()
                for x in (i, j, before[i], before[j]):
                    np.minimum.at(root, x, low)
                root = root[root]
                if (root == before).all():
                    break
            at = to
        has = np.flatnonzero(links)
        if len(has):
            yield pa.RecordBatch.from_arrays([pa.array(node[has]), pa.array(links[has]), pa.array(node[root[has]])], names=["node", "links", "root"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        cell = ["dim", label, "table", "key", "low", "high"]

        def done(rows) -> Iterator:
            """Pairs within whole cells of one dimension: all of a cell of one part, else those between its two parts."""
            n = rows.num_rows
            new = np.ones(n, bool)
            edge = np.zeros(n - 1, bool)
            for c in cell:
                x = rows.column(c).combine_chunks()
                edge |= pc.not_equal(x.slice(1), x.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[1:] = edge
            start = np.flatnonzero(new)
            end = np.repeat(np.append(start[1:], n), np.diff(np.append(start, n)))
            low, high, part = (rows.column(c).to_numpy() for c in ("low", "high", "part"))
            size = np.add.reduceat((part == low).astype(np.int64), start)  # rows of the lower part come first
            middle = np.repeat(start + size, np.diff(np.append(start, n)))
            first = np.where(low == high, np.arange(n) + 1, middle)
            count = np.where((low == high) | (part == low), end - first, 0)
            dims = rows.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)  # one run, as the rows are sorted by dimension
                yield from linked(rows.slice(own[0], len(own)), dim, first[own] - own[0], count[own])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows >= 8192:
                last = {c: held.column(c)[-1] for c in cell}
                same = np.logical_and.reduce([pc.equal(held.column(c), v).to_numpy() for c, v in last.items()])
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                if cut:
                    yield from done(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from done(held)

    return members.mapInArrow(run, "node bigint, links bigint, root bigint")


def embedding_duplicates(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
    recall: float = 0.995,
    bound: float = 4.0,
    min_bits: int = 256,
    cell_rows: int = 1024,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, they have as many components and
    their cosine is at least ``threshold``. n_links counts the other rows linked directly,
    equal vectors included; component_id is the smallest id that links reach; a row is kept
    when it has that id. A vector that is null, empty, zero or holds a null or a value that
    isn't finite, and one without a label, links with nothing and is kept. A row without an
    id links with nothing, has no component and is not kept. Repeated rows are rows of their own
    for n_links, and share their component. An empty table gives no rows; other columns are
    not read. The search misses a pair at the threshold with chance 1 - ``recall`` at most
    (nearer pairs less often); no pair below the threshold links.
    """
    element = dict(df.dtypes)[vector_col]
    vec = F.col(vector_col) if element in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), vec.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    valid = rows.where("good").select("vec_id", "label", "vec", F.size("vec").alias("dim"))
    # one row for each length of vector
    sizes = valid.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()
    plans = {r["dim"]: table_plan(r["dim"], r["n"], threshold, recall) for r in sizes}

    classes = valid.groupBy("dim", "label", "vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    classes = written(encode(classes, plans, min_bits).withColumn("node", F.monotonically_increasing_id()))  # the numbers are fixed by the written table
    places = classes.select("node", "dim", "label", F.posexplode("keys").alias("table", "key"))
    held = ["dim", "label", "table", "key"]
    shared = places.groupBy(*held).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / cell_rows).cast("int"))
    met = places.join(shared, held).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = met.select("node", "table", "key", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    met = met.select("node", "table", "key", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    members = met.join(classes.select("node", "dim", "label", "weight", "vec", "code", "factor", "keys"), "node")
    members = members.repartition("dim", "label", "table", "key", "low", "high").sortWithinPartitions("dim", "label", "table", "key", "low", "high", "part", "node")
    found = written(compare_cells(members, "label", threshold, bound, min_bits))

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found, "node", "root")
    named = links.join(roots, "node").join(classes.select("node", "rep"), "node")
    lowest = named.groupBy("root").agg(F.min("rep").alias("lowest"))
    named = named.join(lowest, "root").select("node", "links", "lowest")
    known = classes.select("node", "dim", "label", "vec", "rep", "weight").join(named, "node", "left")
    known = known.select("dim", "label", "vec", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("lowest", "rep").alias("component_id"))
    out = valid.join(known, ["dim", "label", "vec"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("not good").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(vec_id, got) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON reach.got = link.a),
low AS (SELECT vec_id, min(got) AS component_id FROM reach GROUP BY vec_id),
degree AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN low USING (vec_id) LEFT JOIN degree USING (vec_id)
"""
