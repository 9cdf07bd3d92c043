"""Training-data operators against brute force on small fixtures, with the odd cases that each must survive."""

import math
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from paceforge.llm import decontaminate, exact_dedup, licenses, line_dedup, lm_scoring, packing, quality_crf, simhash, token_counts, toxicity
from paceforge.llm.common import word_hashes
from paceforge.llm.components import connected_components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, block int, row string, keys int"
PROSE = "the quick brown fox jumps over the lazy dog while nobody watches the river flow past old stone bridges and green fields at dusk"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like inner ones."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, PROSE.upper(), None, "b"), (4, "", "en", None), (5, None, None, None), (6, "   \n\t ", "en", "a"),
        (7, long, "en", "a"), (8, long + " tail", "en", "c"), (None, PROSE, "en", "a"), (None, None, None, None), (9, PROSE.replace("fox", "cat") + "\n" + PROSE, "en", "b"),
        (10, "Ünïcode ñandú 中文 all rights\nreserved CC-BY all rightz reserved", "es", "b"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 3, "r", 1) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").persist()


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# ---- exact dedup


def expected_dedup(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    best = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return Counter((i, best[t], len(groups[t]), i is not None and i == best[t]) for i, t in rows)


@pytest.mark.parametrize("colliding", [False, True])
def test_exact_dedup(odd, colliding):
    digest = F.length("text").cast("string") if colliding else None
    got = exact_dedup.exact_dedup(odd, digest=digest).collect()  # by length: every stage must tell colliding texts apart
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == expected_dedup(texts(odd))


@pytest.mark.parametrize("share", [1, 4, 1000])
def test_exact_dedup_large_and_small_groups(spark, odd, monkeypatch, share):
    """All groups by shuffle, some, or all by broadcast: the same result."""
    monkeypatch.setattr(exact_dedup, "SHARE", share)
    many = spark.createDataFrame([(i, f"t{i % 10 if i % 3 else 0}") for i in range(90)] + [(None, "t3"), (7, "alone"), (7, "alone")], "doc_id bigint, text string")
    for df in (odd, many):
        got = exact_dedup.exact_dedup(df).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == expected_dedup(texts(df))


def test_exact_dedup_sql(docs, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = Counter(con.execute(exact_dedup.ORACLE).fetchall())
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()) == want


# ---- SimHash


def hamming(a, b):
    return sum(bin((x ^ y) % 2**64).count("1") for x, y in zip(a, b, strict=True))


def brute_components(nodes, link):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in combinations(nodes, 2):
        if link(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprint_by_hand():
    from xxhash import xxh64_intdigest

    h = [xxh64_intdigest(s, 42) for s in (b"a b c", b"b c d", b"a b c")]
    h = [xxh64_intdigest(b"a b a", 42), xxh64_intdigest(b"b a b", 42), xxh64_intdigest(b"a b a", 42)]
    want = sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > 3)
    assert simhash.fingerprint("A b\ta  B a", 3)[0] % 2**64 == want
    assert simhash.fingerprint("One two", 3)[0] % 2**64 == xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint(" \n", 3) == simhash.fingerprint(None, 3) == [0]


@pytest.mark.parametrize("limit", [32768, 20])
def test_links_lose_nothing(spark, limit):
    rng = np.random.default_rng(5)
    nodes = set()
    for _ in range(4):  # dense balls, and points that stand alone
        centre = int(rng.integers(0, 2**63))
        for _ in range(60):
            x = centre
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(b)
            nodes.add(x - 2**64 if x >= 2**63 else x)
    nodes |= {int(x) for x in rng.integers(-(2**63), 2**63, 60)}
    df = spark.createDataFrame([([n],) for n in nodes], "print array<bigint>")
    found = simhash.links(df, list_limit=limit).collect()
    assert all(hamming(r.a, r.b) <= 3 for r in found)
    mine = brute_components(sorted(nodes), lambda a, b: False)
    pairs = {frozenset((r.a[0], r.b[0])) for r in found}
    mine = brute_components(sorted(nodes), lambda a, b: frozenset((a, b)) in pairs)
    assert mine == brute_components(sorted(nodes), lambda a, b: hamming([a], [b]) <= 3)


def test_simhash_components(docs, odd):
    for df in (docs, odd):
        got = simhash.simhash_components(df).collect()
        rows = texts(df)
        prints = {i: simhash.fingerprint(t, 3)[0] for i, t in rows if i is not None}
        want = brute_components(sorted(prints), lambda a, b: hamming([prints[a]], [prints[b]]) <= 3)  # noqa: B023
        assert len(got) == len(rows)
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
        assert all(int(r.fingerprint, 16) == simhash.fingerprint(dict(rows)[r.doc_id], 3)[0] % 2**64 for r in got if r.doc_id is not None)


def test_long_chain_settles(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a int, b int")
    assert {r.node: r.root for r in connected_components(e).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_near_duplicates(spark):
    base = [f"word{i}" for i in range(200)]
    other = [f"else{i}" for i in range(200)]
    rows = [(1, base), (2, [*base[:100], "new", *base[101:]]), (3, other), (4, base[:100] + other[:100]), (5, base)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect()) == [1, 3, 4]


def edited(rng, ws, n):
    out = list(ws)
    for i in rng.choice(len(out), n, replace=False):
        out[i] = f"e{rng.integers(0, 10**9)}"
    return out


def jaccard_components(rows, size=5, t=0.8):
    sets = {i: frozenset(simhash.shingles(text, size)) for i, text in rows}
    return brute_components(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9)


def test_near_duplicates_of_one_template(spark, monkeypatch):
    """All meet in every list of the index, most within its bits: the forests leave out true pairs."""
    rng = np.random.default_rng(8)
    template = [f"t{i}" for i in range(300)]
    rows = []
    for k in range(40):
        own = edited(rng, template, 6)
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(edited(rng, own, 1)))]
    monkeypatch.setattr(simhash, "key_masks", lambda level: [0] * 8 * 4**level)
    want = jaccard_components(rows)
    assert len(set(want.values())) > 20
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == want


def test_near_duplicates_recall(spark):
    """All pairs at Jaccard 0.8, those close to it too, short texts and repeated words among them."""
    rng = np.random.default_rng(9)
    rows = []
    for n in range(120):
        ws = [f"w{rng.integers(0, 3000)}" for _ in range(int(rng.integers(8, 240)))]
        rows += [(2 * n, " ".join(ws)), (2 * n + 1, " ".join(edited(rng, ws, max(1, round(len(ws) * (n % 6) / 220)))))]
    want = jaccard_components(rows)
    assert 30 < len(rows) - len(set(want.values())) < 110
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == want


# ---- line dedup


def brute_lines(rows, t=0.8, least=1):
    lines = sorted({(i, k, frozenset(x for x in re.split("[ \t\r\f\x0b]+", line.lower()) if x)) for i, text in rows if i is not None for k, line in enumerate(text.split("\n"))}, key=lambda x: x[:2])
    lines = [x for x in lines if len(x[2]) >= least]
    return {y[:2] for n, y in enumerate(lines) for x in lines[:n] if x[:2] < y[:2] and len(x[2] & y[2]) >= t * len(x[2] | y[2]) - 1e-9}


def test_line_dedup(docs, odd):
    for df in (docs, odd):
        rows = texts(df)
        want = brute_lines(rows)
        assert {(r.doc_id, r.line_no) for r in line_dedup.removed_lines(df).collect()} == want
    cut = line_dedup.dedup_lines(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    assert {r.doc_id: r.text for r in cut.collect()}[2] == "" and {r.doc_id: r.text for r in cut.collect()}[5] is None
    clash = odd.withColumnRenamed("digest", "__cut").withColumnRenamed("row", "__id")
    assert line_dedup.dedup_lines(clash).columns == clash.columns and line_dedup.dedup_lines(clash).count() == odd.count()
    report = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup.line_report(odd).collect()}
    assert report[2] == (1, [0]) and report[1] == (1, [])


def test_lines_of_one_template(spark):
    """Versions of long lines, most near the first one and some far from it; a match may be any earlier line."""
    rng = np.random.default_rng(6)
    rows = []
    for n in (40, 260):
        template = [f"t{n}x{i}" for i in range(n)]
        rows += [" ".join(edited(rng, template, int(n * rng.choice([0.02, 0.05, 0.12, 0.16])))) for _ in range(120)]
    rows = list(enumerate(rows))
    got = {(r.doc_id, r.line_no) for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_lines(rows) and 60 < len(got) < 230


def test_lines_of_unlike_sizes(spark):
    """Sets whose similarity is just 0.8 or just below by their sizes alone, of all sizes, the larger one first or last."""
    rng = np.random.default_rng(12)
    lines = []
    for n in range(4, 90, 2):
        more = rng.permutation(700)
        fit = int(n / 0.8 + 1e-9)
        lines += [" ".join(f"v{x}" for x in rng.permutation(more[:m])) for m in (n, fit, fit + 1)]
        lines.append(" ".join(f"v{x}" for x in [*more[: n - n // 10], *more[600 : 600 + n // 10]]))
    lines = [lines[i] for i in rng.permutation(len(lines))]
    rows = [(i, "\n".join(lines[i::9])) for i in range(9)]
    got = {(r.doc_id, r.line_no) for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_lines(rows) and len(got) > 40


def test_short_lines_and_white_space(spark, monkeypatch):
    """Lines of 1 to 6 words against all pairs, through the query; tabs and carriage returns part words."""
    from paceforge.llm import queries

    rng = np.random.default_rng(4)
    lines = [" ".join(f"v{x}" for x in rng.integers(0, 7, rng.integers(1, 7))) for _ in range(150)]
    lines += ["Read more here", "read more here\r", "read\tmore\x0bhere", "a b c d e f g h\r", "a\tb\tc\td\te\tf\tg\th", "one two three four five\r", "one two three four five"]
    rows = [(i, "\n".join(lines[i::20])) for i in range(20)]
    at = [(i, k, frozenset(line.lower().encode().split())) for i, text in rows for k, line in enumerate(text.split("\n"))]
    want = {y[:2] for n, y in enumerate(at) for x in at[:n] if len(x[2] & y[2]) >= 0.8 * len(x[2] | y[2]) - 1e-9}
    monkeypatch.setattr(queries, "read_table", lambda *_: spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {(r.doc_id, k) for r in queries.op6_line_dedup(spark, "").collect() for k in r.removed} == want


# ---- decontamination


def test_leaks_plain_and_reparameterised(spark):
    item = "If Anna drives 40 km in 2 hours and then Bob drives 40 km in 5 hours how far do both go in one day of steady travel"
    swap = item.replace("Anna", "Carla").replace("Bob", "David").replace("40", "75").replace(" 5 ", " 9 ")
    uneven = swap.replace("David drives 75", "David drives 31")
    bench = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, "")], "item_id bigint, text string")
    rows = [(1, "noise before it. " + item + " and after"), (2, "Some words here. " + swap), (3, "Some words here. " + uneven), (4, PROSE), (5, None), (6, "a very short one indeed"), (None, item), (7, item), (7, item)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(df, bench).collect()}
    assert {k for k, r in got.items() if r.contaminated} == {(1, 1), (2, 1), (6, 2), (7, 1)}
    assert got[(1, 1)].coverage == 1 and not got[(1, 1)].template and got[(2, 1)].template and got[(2, 1)].n_slots > 4
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect() if r.doc_id) == [3, 4, 5]


def test_leaks_in_documents(docs, spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = {r.item_id: " ".join(r.text.split()) for r in bench.collect()}
    want = {(i, k) for i, t in texts(docs) for k, item in items.items() if item in " ".join(t.split())}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).where("contaminated").collect()}
    assert want and want <= got


def naive_leaks(docs, items, size):
    """Matched places of each (document, item) by comparing all windows word by word; items of at least ``size`` words."""
    memo, out = decontaminate.Canon(), {}

    def read(text):
        tokens, plain, template, slot = decontaminate.canonical(text, memo)
        return plain.tolist(), template.tolist(), slot.tolist(), [t.strip(decontaminate._EDGE).lower() for t in tokens]

    def lengths(slot, i):
        for k in range(decontaminate.LONGER + 1):
            n = size << k
            own = slot[i : i + n]
            if len(own) == n and sum(x == 0 for x in own) >= size // 2 + 2 * k:
                return n if any(own) else 0
        return 0

    for d, text in docs:
        dp, dt, ds, dw = read(text)
        for k, item in items:
            ip, it, isl, iw = read(item)
            places = set()
            for diagonal in range(-len(ip), len(dp)):
                plain, sub = set(), []
                for i in range(max(0, -diagonal), min(len(ip), len(dp) - diagonal) - size + 1):
                    j = i + diagonal
                    if ip[i : i + size] == dp[j : j + size]:
                        plain.add(i)
                    n = lengths(isl, i)
                    if n and n == lengths(ds, j) and it[i : i + n] == dt[j : j + n]:
                        sub.append((i, n, [((isl[i + x], iw[i + x]), dw[j + x]) for x in range(n) if isl[i + x]]))
                stands = {}
                for _, _, pairs in sub:
                    for a, b in pairs:
                        stands.setdefault(a, set()).add(b)
                places |= plain
                for i, n, pairs in sub:
                    if all(len(stands[a]) == 1 for a, _ in pairs):
                        places |= set(range(i, i + n - size + 1))
            if places:
                out[d, k] = (len(places), len(ip) - size + 1)
    return out


def test_leaks_reparameterised_in_harder_ways(spark):
    """Values that fall together, sentences that begin with a name, items dense in names and numbers; against brute force over all windows."""
    apples = "A farmer packs 3 boxes of red apples and 5 boxes of green pears into a truck before the market opens at noon how many boxes are in the truck"
    trains = "Anna leaves the north station at 9 with a heavy bag. Bob leaves the south station at 10 with a small box. Carl waits for both of them near the old bridge until 12 and then walks home."
    dense = "Anna Brown paid 12 dollars 30 cents to Carl Green on 5 March 2020 while David White paid Emma Black 40 euros 15 cents at 7 Hill Road and Frank Stone gave 8 pounds to George Young on 9 April 2021 so who paid more"
    swap = lambda text, **to: " ".join(to.get(w.strip("."), w.strip(".")) + w[len(w.rstrip(".")) :] for w in text.split())
    one = apples.replace(" 3 ", " 7 ").replace(" 5 ", " 7 ")
    two = swap(trains, Anna="Julia", Bob="Kevin", Carl="Laura", **{"9": "4", "10": "6", "12": "8"})
    three = swap(dense, Anna="Olga", Brown="Hall", Carl="Peter", Green="Moore", David="Quinn", White="Reed", Emma="Rosa", Black="Shaw", March="June", Frank="Tom", Stone="West", George="Umar", Young="York", April="July", **{"12": "31", "30": "77", "5": "6", "40": "51", "15": "16", "8": "3", "9": "2", "7": "99"})
    uneven = dense.replace("David White paid", "David White sent").replace("paid more", "won it")
    items = [(1, apples), (2, trains), (3, dense)]
    rows = [(1, "Some words first. " + one + " and more"), (2, "Some words first. " + two), (3, "Here it is: " + three + " or less"), (4, PROSE), (5, PROSE + " " + uneven), (6, "The Smith family of 4 paid 12 dollars to Mary Jones on 5 May 1999 and went home to Paris")]
    bench, df = spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(df, bench).collect()}
    assert {k for k, r in got.items() if r.contaminated and k[0] != 5} == {(1, 1), (2, 2), (3, 3)}
    assert all(got[k, k].template for k in (1, 2, 3))
    assert {k: (r.matched, r.item_windows) for k, r in got.items()} == naive_leaks(rows, items, 8)
    unsized = {(r.doc_id, r.item_id): r.matched for r in decontaminate.leaks(df, bench, small_benchmark=0).collect()}
    assert unsized == {k: r.matched for k, r in got.items()}


def test_leaks_on_odd_and_empty_tables(spark, odd, empty):
    """Clashing columns, nulls, very long texts and repeated rows; no documents; no items."""
    bench = spark.createDataFrame([(1, PROSE), (1, PROSE), (None, PROSE), (2, None)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd, bench).where("contaminated").collect()}
    assert got == {(i, 1) for i in (1, 2, 3, 9)}
    left = decontaminate.drop_contaminated(odd, bench)
    assert left.columns == odd.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 4, 5, 6, 7, 8, 10]
    assert decontaminate.drop_contaminated(empty, bench).count() == 0
    assert decontaminate.drop_contaminated(odd, bench.limit(0)).count() == odd.count()


# ---- packing


def naive_pack(items, capacity):
    bins, out = [], []
    for size, s, c in items:
        fits = [(b[0], n) for n, b in enumerate(bins) if b[0] >= size and (s is None or s not in b[1]) and (c is None or c not in b[2])]
        n = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([capacity, set(), set()])
        bins[n][0] -= size
        bins[n][1].add(s)
        bins[n][2].add(c)
        out.append(n)
    return out


def test_block_like_a_loop():
    rng = np.random.default_rng(2)
    for _ in range(20):
        items = sorted(((int(rng.integers(1, 100)), [None, "a", "b", "c", "d"][rng.integers(0, 5)], [None, 1, 2, 3, 4, 5, 6][rng.integers(0, 7)]) for _ in range(80)), key=lambda x: -x[0])
        assert packing.pack_block(items, 100) == naive_pack(items, 100)


def test_packing_rules(docs, odd):
    for df in (docs, odd):
        got = packing.pack_documents(df, capacity=500, block_rows=64).collect()
        need = Counter()
        for i, t in texts(df):
            need[i] += len(re.findall(r"[^\x20\x09-\x0D]+", t))
        have, bins = Counter(), {}
        for r in got:
            have[r.doc_id] += r.n_words
            if r.bin_id is not None:
                bins.setdefault(r.bin_id, []).append(r)
        assert {k: v for k, v in have.items() if v} == {k: v for k, v in need.items() if v}
        for rows in bins.values():
            assert sum(r.n_words for r in rows) <= 500 and len({r.bin_words for r in rows}) == 1
            sources = [r.source for r in rows if r.source is not None]
            assert len(sources) == len(set(sources)) and len({r.cluster for r in rows}) == len(rows)


# ---- license scans


def test_licenses(docs, odd):
    bases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for df in (docs, odd):
        rows = dict(texts(df))
        for r in licenses.license_scan(df).where("doc_id is not null").collect():
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in rows[r.doc_id])
            ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
            places = [(i, b) for p, b in bases.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
            starts = [i for i, _ in places]
            assert (r.n_words, r.n_base) == (len(ws), len(places)) and r.base_labels == ",".join(sorted({b for _, b in places}))
            assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
            assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    spans = licenses.license_spans(odd).where("doc_id = 10").collect()
    assert {(r.label, r.matched, r.errors) for r in spans if not r.base} == {("reserved", "all rights\nreserved", 0), ("reserved", "all rightz reserved", 1)}


# ---- token counts


def test_many_notices_in_one_text():
    """Word places of tens of thousands of notices in one text, by a loop over its words."""
    words = ("x cc by y", "all rights reserved", "mozilla publik license z", "général")
    text = "\n".join(words[(7 * i + i // 5) % 4] for i in range(40_000))
    n, hits = licenses.Scanner(licenses.NOTICES).scan(text)
    split = text.split()
    assert n == len(split)
    for label, phrase in (("cc-by", ["cc", "by"]), ("reserved", ["all", "rights", "reserved"])):
        want = [i for i in range(n) if split[i : i + len(phrase)] == phrase]
        assert sorted(h[1] for h in hits if h[0].base and h[0].label == label) == want
    assert sorted({h[1] for h in hits if h[0].label == "mpl"}) == [i for i in range(n) if split[i] == "mozilla"]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens_add_up(odd, rule):
    got = token_counts.section_tokens(odd, rule=rule).collect()
    sums = Counter()
    for r in got:
        sums[r.doc_id] += r.n_tokens
    for r in got:
        assert r.doc_id in (2, None) or abs(sums[r.doc_id] - r.doc_tokens) < 1e-6
    assert {r.section for r in got if r.doc_id == 9 and r.field == "text"} == {0, 1}


def test_attribution_by_hand():
    ends, sections = np.array([3, 5, 9, 12]), np.array([4, 4, 8, 12])
    want = {"start": [2, 0, 1, 1], "end": [1, 0, 1, 2], "majority": [2, 0, 1, 1], "fraction": [1.5, 0, 0.5 + 0.75, 1.25]}
    for rule, w in want.items():
        assert token_counts.attribute(ends, sections, rule).tolist() == pytest.approx(w)


# ---- models


def test_quality(docs, labels, odd):
    field = quality_crf.fit_quality(docs, labels, keep=F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    want = {r.doc_id: r.quality for r in labels.collect()}
    got = [r for r in quality_crf.score_quality(docs, field).collect() if r.doc_id in want]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == want[r.doc_id] for r in held) >= 0.9 * len(held)
    assert quality_crf.score_quality(odd, field).count() == odd.count()


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    chains, trans = [rng.normal(size=(n, 2)) for n in (1, 4, 2)], rng.normal(size=(2, 2))
    packed, _, _ = quality_crf.packed_marginals(chains, trans)
    for emit, other in zip(chains, packed, strict=True):
        post = np.zeros_like(emit)
        for k in range(2 ** len(emit)):
            path = [k >> i & 1 for i in range(len(emit))]
            p = math.exp(sum(emit[i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)))
            for i, y in enumerate(path):
                post[i, y] += p
        post /= post.sum(axis=1, keepdims=True)
        assert np.allclose(quality_crf.forward_backward(emit, trans)[0], post) and np.allclose(other, post)


def test_toxicity(spark, odd, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    chain = toxicity.fit_chain(d, lab, keep=F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    want = {r.doc_id: r.toxic for r in lab.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    got = {r.doc_id: r.rejected for r in toxicity.score_toxicity(d, chain).collect() if r.doc_id in want}
    assert sum(got[i] for i, y in want.items() if not y) <= 0.01 * len(want)
    assert sum(got[i] for i, y in want.items() if y) >= 0.6 * sum(want.values())
    assert toxicity.score_toxicity(odd, chain).count() == odd.count() and toxicity.drop_toxic(odd, chain).columns == odd.columns
    none = toxicity.fit_chain(empty, lab.limit(0))
    assert not any(r.rejected for r in toxicity.score_toxicity(odd, none).collect())


def test_last_link_decides(spark):
    """The last link sees both others; a chain in which only it rejects, or only it accepts, is followed."""
    words = [(i, f"{'foul nasty vile' if i % 2 else 'kind soft calm'} x{i % 7} y{i % 5}", i % 2, i % 4 // 2) for i in range(200)]
    d = spark.createDataFrame(words, "doc_id bigint, text string, toxic int, quality int")
    chain = toxicity.fit_chain(d.select("doc_id", "text"), d.select("doc_id", "toxic", "quality"))
    assert chain.categories[-1] == "toxic" and [len(v) for v in chain.dense] == [1, 2, 3] and np.abs(chain.dense[-1][1:]).sum() > 0
    for last in (9.0, -9.0):
        made = toxicity.Chain(["prose_abuse", "junk_abuse", "toxic"], {}, [np.zeros(0)] * 3, [np.array([-last]), np.array([-last, 0]), np.array([last, 0, 0])])
        assert toxicity.drop_toxic(d, made).count() == (0 if last > 0 else 200)
        assert toxicity.score_toxicity(d, made).where("rejected").count() == (200 if last > 0 else 0)


def test_lm_scores(docs, odd):
    for df in (docs, odd):
        rows = texts(df)
        tokens = split_tokens(rows)
        seen = Counter(x for i, ts in tokens if zlib.crc32(("" if i is None else str(i)).encode()) % 10 for x in ts)
        n, v = sum(seen.values()), len(seen)
        want = Counter((i, len(ts), sum(seen[x] > 0 for x in ts), round(sum(math.log10((seen[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts), 4)) for i, ts in tokens)
        got = lm_scoring.score_texts(df, top_words=50).collect()
        assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
        assert all(r.score < 0 and r.train_tokens == n for r in got)


def exact_scores(tokens, held, prior=8.0, quantised=False):
    """log10 probabilities of (id, tokens) by counts in dictionaries, or by the middles of their levels."""
    train = [ts for i, ts in tokens if not held(i)]
    values = lm_scoring.level_values()
    level = lambda c: float(values[lm_scoring.levels_of(np.array([c]))[0]]) if c else 0.0
    see = level if quantised else float
    uni, bi = Counter(x for ts in train for x in ts), Counter(p for ts in train for p in zip(["<", *ts], ts, strict=False))
    n, v = sum(uni.values()), len(uni)
    out = []
    for i, ts in tokens:
        s = 0.0
        for h, w in zip(["<", *ts], ts, strict=False):
            pair = see(bi[h, w])
            context = max(see(len(train) if h == "<" else uni[h]), pair)
            s += math.log10((pair + prior * (see(uni[w]) + 0.1) / (n + 0.1 * (v + 1))) / (context + prior))
        out.append((i, s))
    return dict(out)


def split_tokens(rows):
    return [(i, re.findall(rb"[^\x20\x09-\x0D]+", t.encode().translate(lm_scoring.LOWER)) + [None]) for i, t in rows]


def test_lm_score_against_exact_counts(docs):
    tokens = split_tokens(texts(docs))
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    got = {r.doc_id: r for r in lm_scoring.score_texts(docs).collect()}
    off = [abs(got[i].score / want - 1) for i, want in exact_scores(tokens, held, quantised=True).items()]
    assert max(off) < 0.15 and np.mean(off) < 0.01  # the filter's hits that are none change little
    exact = exact_scores(tokens, held)
    assert sum(r.score for r in got.values()) == pytest.approx(sum(exact.values()), rel=0.02)
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)
    parts = lm_scoring.score_texts(docs, shard_tokens=2000, part_mb=0).collect()  # a pass for each shard
    assert sum(r.score for r in parts) == pytest.approx(sum(r.score for r in got.values()), rel=0.001)
    assert all(r.base_score == pytest.approx(got[r.doc_id].base_score) for r in parts)


def test_filter_at_full_load():
    """A shard as the query builds it never forgets, and takes 1 % of others for its own."""
    h = np.arange(1, 400_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    top = lm_scoring.levels_of(np.random.default_rng(3).zipf(1.8, len(h)).clip(1, 10**9))
    bits = np.frombuffer(lm_scoring.Filter.fill(h, top), np.uint8)
    f = lm_scoring.Filter(bits, np.array([0, len(bits)]))
    found = f.level(h)
    assert (found >= top).all() and (found == top).mean() > 0.985
    assert (f.level(h + np.uint64(1)) == 0).mean() > 0.985
    assert 0.4 < np.unpackbits(bits).mean() < 0.5


def test_word_hashes():
    texts = ["A b\ta  B a", "", "  ", "ünï b", "x" * 3_000_000 + " b"]
    h, n = word_hashes(texts, lm_scoring.LOWER)
    assert n.tolist() == [5, 0, 0, 2, 2]
    a, b = h[0], h[1]
    assert h[:5].tolist() == [a, b, a, b, a] and h[6] == b and h[8] == b and len(set(h.tolist())) == 4
    assert np.array_equal(word_hashes(["b"])[0], [b])
    # equal words have equal hashes wherever they stand and however long they are; others differ, by one byte or a zero at the end too
    some = [f"w{i}" * k for i in range(300) for k in (1, 3, 4, 9, 20, 30)] + ["x" * k for k in range(1, 140)] + ["x\0", "x\0\0", "\0", "\0\0"]
    h, _ = word_hashes([" ".join(some)])
    alone = [int(word_hashes([w])[0][0]) for w in some]
    assert h.tolist() == alone and len(set(alone)) == len(set(some))


def test_words_that_a_polynomial_confuses(spark):
    """The two Thue-Morse words of any length collide in polynomials modulo 2^64 from 1,024 letters on."""
    for k in range(3, 12):
        one = "".join("ab"[i.bit_count() % 2] for i in range(1 << k))
        other = one.translate(str.maketrans("ab", "ba"))
        assert len(set(word_hashes([f"{one} {other}"])[0].tolist())) == 2
    df = spark.createDataFrame([(1, one), (2, other)], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == {1: 1, 2: 2}


# ---- empty tables and the pipeline


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    for df in (
        exact_dedup.exact_dedup(empty), simhash.simhash_components(empty), simhash.near_duplicates(empty), line_dedup.line_report(empty), line_dedup.dedup_lines(empty),
        decontaminate.leaks(empty, bench), packing.pack_documents(empty), licenses.license_scan(empty), token_counts.section_tokens(empty), lm_scoring.score_texts(empty),
    ):
        assert df.count() == 0


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline as p

    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    now, kept = docs, {}
    for name, stage in p.STAGES[:4]:
        out = stage(spark, now, sf_dir)
        assert out.columns == docs.columns
        now = spark.createDataFrame(out.collect(), docs.schema).persist()
        kept[name] = {r.doc_id: r.text for r in now.collect()}
    assert set(kept["line_dedup"]) == set(kept["toxicity"])
    assert not {i for i in kept["toxicity"] if labels.get(i)} or len([i for i in kept["toxicity"] if labels.get(i)]) <= 0.3 * sum(labels.values())
    before = {i: {" ".join(s.decode() for s in [x]) for x in simhash.shingles(t, 5)} for i, t in kept["line_dedup"].items()}
    for gone in set(kept["line_dedup"]) - set(kept["near_dup"]):
        assert any(i < gone and len(s & before[gone]) >= 0.6 * len(s | before[gone]) for i, s in before.items())
    packed = p.run(spark, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(kept["decontamination"])
