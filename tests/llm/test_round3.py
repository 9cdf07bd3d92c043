"""Embedding near-duplicates, tokenizer alignment and collocations against brute force, with the odd cases that each must survive."""

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from paceforge.llm import alignment, collocations, embedding_dedup

# ---- embeddings

VECTORS = "vec_id bigint, embedding array<float>, label int, node bigint, dim string, n_links int"


def brute_links(rows, threshold=0.93):
    """(vec_id, n_links, component_id, kept) for each row: links between rows, and the smallest id that they reach."""

    def usable(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    good = [i for i, r in enumerate(rows) if usable(r)]
    vec = {i: np.array(rows[i][1], np.float32).astype(float) for i in good}
    near = defaultdict(set)
    for x, i in enumerate(good):
        for j in good[x + 1 :]:
            if rows[i][2] == rows[j][2] and len(vec[i]) == len(vec[j]) and vec[i] @ vec[j] / math.sqrt((vec[i] @ vec[i]) * (vec[j] @ vec[j])) >= threshold:
                near[i].add(j)
                near[j].add(i)
    low = {i: rows[i][0] for i in range(len(rows))}
    seen = set()
    for i in good:
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()] - group:
                    group.add(j)
                    todo.append(j)
            seen |= group
            for j in group:
                low[j] = min(rows[x][0] for x in group)
    return Counter((r[0], len(near[i]), low[i], r[0] is not None and r[0] == low[i]) for i, r in enumerate(rows))


def got_links(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS)
    return Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_duplicates(df, **more).collect())


def cloud(seed, n=300, dim=64):
    """Groups of near copies at cosines on both sides of the threshold, exact copies, and strangers."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.standard_normal(dim)
        if rows and rng.random() < 0.5:
            base = np.array(rows[int(rng.integers(len(rows)))][1])
            v = base / np.linalg.norm(base) + rng.uniform(0, 0.5) * v / np.linalg.norm(v)
        rows.append((i * 3 % 1000, v.tolist(), int(rng.integers(2))))
        if rng.random() < 0.1:
            rows.append((5000 + i, v.tolist(), rows[-1][2]))
    return rows


@pytest.mark.parametrize("cell_rows", [3, 1024])
def test_links_equal_brute_force(spark, cell_rows):
    rows = cloud(5)
    want = brute_links(rows)
    assert sum(n for _, n, _, _ in want.elements()) > 100
    assert got_links(spark, rows, recall=0.99999, cell_rows=cell_rows) == want  # small cells: every two parts of a bucket meet once


def test_links_of_odd_vectors(spark):
    v, w = [1.0] * 8, [1.0] * 7 + [0.9]
    bad = [None, [], [0.0] * 8, [1.0, None] * 4, [float("nan")] + v[1:], [float("inf")] + v[1:]]
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (3, w, 0), (4, v, None), (5, v, 1), (6, [x * 1e-30 for x in v], 0), (7, [x * 1e30 for x in w], 0), (8, v[:4], 0), (None, v, 0), (9, [0.0, -0.0] + v[2:], 1)]
    rows += [(20 + i, b, 0) for i, b in enumerate(bad)] + [(40, [2.0], 3), (41, [3.0], 3), (42, [-3.0], 3), (43, v, 0)]
    want = Counter()
    for k, n in brute_links([r for r in rows if r[0] not in (6, 7)] + [(6, v, 0), (7, w, 0)]).items():  # those two only differ in length
        want[k] += n
    assert got_links(spark, rows, recall=0.99999) == want


def test_links_of_an_empty_table(spark):
    assert not got_links(spark, [])
    assert got_links(spark, [(1, None, 0), (2, [1.0], None)]) == Counter({(1, 0, 1, True): 1, (2, 0, 2, True): 1})


def test_recall_at_the_threshold():
    """Pairs of a cosine just at the threshold share a key with the promised chance, in small and large tables."""
    rng = np.random.default_rng(8)
    for dim, rows in ((64, 5000), (64, 10**7), (100, 10**5)):
        a, b = embedding_dedup.unit(rng.standard_normal((3000, dim))), rng.standard_normal((3000, dim))
        b = embedding_dedup.unit(b - (a * b).sum(1, keepdims=True) * a)
        b = 0.93 * a + math.sqrt(1 - 0.93**2) * b
        plan = embedding_dedup.table_plan(dim, rows, 0.93, 0.98)
        met = (embedding_dedup.bucket_keys(a, *plan) == embedding_dedup.bucket_keys(b, *plan)).any(1).mean()
        assert met >= 0.965
        code, factor = embedding_dedup.codes(b, 256)
        est = embedding_dedup.estimates(code, factor, embedding_dedup.planes(a, 256), 256)
        assert abs(est.mean() - 0.93) < 0.005  # without bias
        assert (np.abs(est - 0.93) <= embedding_dedup.half_width(factor, 256, 4.0)).mean() > 0.999


def test_embedding_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = embedding_dedup.embedding_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == Counter(con.execute(embedding_dedup.ORACLE).fetchall())


# ---- alignment

DOCS = "doc_id bigint, text string, lang string, chunk int, place string, n int"


@pytest.fixture(scope="module")
def encoders():
    with open(alignment.BYTE_BPE, "rb") as f, open(alignment.PIECE_BPE, "rb") as g:
        return alignment.Encoders(f.read(), g.read())


def brute_alignment(enc, rows):
    """Whole texts encoded as they are, and all overlapping pairs by a double loop over neighbours."""
    docs, pairs = [], Counter()
    for i, t in rows:
        raw = (" " + (t or "")).encode()
        a, b = enc.a.encode(" " + t, add_special_tokens=False).ids if t else [], enc.b.encode(t) if t else []
        if b"".join(enc.a_bytes[x] for x in a) != raw or b"".join(enc.b_bytes[x] for x in b) != raw:
            docs.append((i, [], [], "", [], 0))
            continue
        spans = []
        for ids, table in ((a, enc.a_bytes), (b, enc.b_bytes)):
            ends = np.cumsum([len(table[x]) for x in ids]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends, ids, strict=True)))
        links = []
        at = 0
        for s, e, x in spans[0]:
            while at and spans[1][at - 1][1] > s:
                at -= 1
            while spans[1][at][1] <= s:
                at += 1
            k = at
            while k < len(b) and spans[1][k][0] < e:
                links.append((x, spans[1][k][2]))
                k += 1
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [([], []) for _ in common]
        for side in (0, 1):
            for _, e, x in spans[side]:
                groups[bisect_left(common, e)][side].append(str(x))
        docs.append((i, a, b, hashlib.sha256(";".join(",".join(x) + "|" + ",".join(y) for x, y in groups).encode()).hexdigest(), links, len(common)))
        pairs.update(links)
    best = {}
    for (_, b), n in pairs.items():
        best[b] = max(best.get(b, 0), n)
    return Counter((i, len(a), len(b), g, len(links), sum(pairs[p] == best[p[1]] for p in links), sum(pairs[p] for p in links), sha) for i, a, b, sha, links, g in docs)


@pytest.mark.parametrize("chunk_bytes", [200, 1 << 22])
def test_alignment_equals_brute_force(spark, encoders, chunk_bytes):
    rng = random.Random(4)
    pool = [" ", "  ", "\n", "\t", "\xa0", "　", " ", "​", "▁", "'s", "'LL", "a", "é", "ß", "中", "日本", "</s>", "<s>", "<|endoftext|>", "<unk>", "<0x41>", "\x1c", "\x85", "1", "23", "!", "...", "😀", "word", "Words", "ﬁ", "\r\n"]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))) for i in range(250)]
    rows += [(300, None), (301, ""), (302, " "), (302, " "), (None, "no id here"), (303, "many words " * 3000), (304, "x" * 3000)]
    df = spark.createDataFrame([(*r, "en", 1, "p", 2) for r in rows], DOCS)
    got = alignment.align_tokenizers(df, chunk_bytes=chunk_bytes).collect()
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == brute_alignment(encoders, rows)


def test_alignment_of_the_documents(spark, sf_dir, encoders):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = alignment.align_tokenizers(docs).collect()
    want = brute_alignment(encoders, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == want


def test_stretches_are_encoded_once(monkeypatch):
    """A full memory keeps the stretches that are asked for, and their ids."""
    monkeypatch.setattr(alignment, "KEPT_UNITS", 3)
    with open(alignment.BYTE_BPE, "rb") as f, open(alignment.PIECE_BPE, "rb") as g:
        enc = alignment.Encoders(f.read(), g.read())
    encode, seen = enc.b.encode, []
    monkeypatch.setattr(enc, "b", type("Seen", (), {"encode": lambda self, texts, **kw: seen.extend(texts) or encode(texts, **kw)})())
    first, second = [b" the", b" of", b" <s>", "  \u2581".encode()], [b" of", b" number", "  \u2581".encode(), b" the"]
    for units in (first, second, first):
        places = enc.units(units)
        for u, at in zip(units, places.tolist(), strict=True):
            a, b = (x[at].as_py() for x in enc.lists)
            assert a == enc.a.encode(u.decode(), add_special_tokens=False).ids and b == encode(u.decode()[1:])
            assert enc.same[at] == (b"".join(enc.b_bytes[i] for i in b) == u)
    assert sorted(seen) == sorted(["the", "of", "<s>", " \u2581", "number", "<s>"])  # only what the second call did not ask for is forgotten


def test_alignment_of_an_empty_table(spark):
    assert alignment.align_tokenizers(spark.createDataFrame([], DOCS)).collect() == []
    got = alignment.align_tokenizers(spark.createDataFrame([(1, None, None, 1, "", 1)], DOCS)).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "")]


# ---- collocations

TEXTS = "doc_id bigint, text string, lang string, gram string, k int, n bigint"


def brute_counts(rows):
    counts = Counter()
    for text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            for k in range(1, 6):
                counts.update(("und" if lang is None else lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return counts


def brute_collocations(rows, least, top):
    counts = brute_counts(rows)
    totals = Counter()
    for (lang, w), n in counts.items():
        totals[lang] += n * (len(w) == 1)
    cand = {x: n for x, n in counts.items() if len(x[1]) > 1 and n >= least}
    inside = set()
    for (lang, w), n in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * n >= 100 * counts[lang, w[i : i + k]]:
                    inside.add((lang, w[i : i + k]))
    by = defaultdict(list)
    for (lang, w), a in cand.items():
        if (lang, w) not in inside:
            score, k = min((1000 * a * totals[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w)))
            by[lang].append((-score, -a, " ".join(w).encode(), a, counts[lang, w[:k]], counts[lang, w[k:]]))
    out = set()
    for lang, found in by.items():
        for rank, (s, _, p, a, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), a, left, right, totals[lang], -s))
    return out


def mined(spark, rows, least, top):
    df = spark.createDataFrame([(i, t, lang, "g", 1, 2) for i, (t, lang) in enumerate(rows)], TEXTS)
    return {tuple(r) for r in collocations.mine_collocations(df, min_count=least, top=top).collect()}


def test_collocations_equal_brute_force(spark):
    rng = random.Random(2)
    long = " ".join(f"p{i}" for i in range(130))
    rows = [(" ".join(rng.choice("a B c d É f".split()) for _ in range(rng.randint(0, 30))) + rng.choice(["", ". x y", "\n", ";;", "\t\t"]), rng.choice(["en", "de", None])) for _ in range(200)]
    rows += [(long, "en")] * 6 + [("t t t t t t t t t", "en")] * 3 + [("u v w u v w u v w u v w u v w. ", "de")] * 4 + [(None, "en"), ("", None), (" \t\n ", "fr"), ("one", ""), ("A" * 5000 + " b", "en")] + [(long.replace("p", "q"), "de")] * 5
    for least, top in ((2, 10**6), (5, 10**6), (5, 7)):
        want = brute_collocations(rows, least, top)
        assert want and mined(spark, rows, least, top) == want


def test_paths_hold_every_edge_once(spark):
    """Boilerplate becomes one path; circles and forks keep their edges."""
    long = [f"p{i}" for i in range(130)]
    grams = {tuple(long[i : i + 5]): 9 for i in range(126)} | {tuple("abcdefgabcdefg"[i : i + 5]): 4 for i in range(7)} | {tuple("vwxyz"): 2, tuple("vwxyA"): 3, tuple("wxyAB"): 3}
    df = spark.createDataFrame([("en", 5, " ".join(g), n) for g, n in grams.items()] + [("en", 4, "p60 p61 p62 p63", 2)], "lang string, k int, gram string, n bigint")
    paths = collocations.compact_paths(df).collect()
    got = Counter()
    for r in paths:
        for i in range(len(r.words) - 4):
            got[tuple(r.words[i : i + 5])] += r.weight
    assert got == Counter(grams)
    assert {len(r.words) for r in paths} >= {64, 70}  # the passage, cut at the node with a tail (p60 .. p63)
    assert ["v", "w", "x", "y", "A", "B"] in [r.words for r in paths]


@pytest.mark.parametrize("held", [1 << 20, 40])
def test_a_task_makes_one_row_for_each_run(spark, held):
    """However many chunks it has, unless there is no room for so many runs."""
    rows = [("en" if i % 2 else None, " ".join(f"w{(i + j) % 7}" for j in range(3 + i % 6)) + ". of the, of the") for i in range(200)]
    texts = spark.createDataFrame(rows, "lang string, text string").selectExpr("cast(coalesce(lang, 'und') as binary) as lang", "cast(text as binary) as text").coalesce(1)
    tables = [b"\xff" * (collocations.SLOTS // 8)] * 3
    got = collocations.counted_grams(texts, tables, chunk_bytes=300, held_rows=held).collect()
    want = Counter()
    for lang, text in rows:
        for piece in re.split("[.,]", text):
            w = piece.split()
            for i in range(len(w)):
                want[lang or "und", min(5, len(w) - i), " ".join(w[i : i + 5])] += 1
    total = Counter()
    for r in got:
        total[r.lang, r.k, r.gram] += r.n
    assert total == want
    assert (len(got) == len(want)) == (held > 40)


def test_collocation_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = collocations.mine_collocations(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert {tuple(r) for r in got} == set(con.execute(collocations.ORACLE).fetchall())


def test_collocations_of_an_empty_table(spark):
    assert not mined(spark, [], 2, 10)
    assert not mined(spark, [(None, None), ("only once said", "en")], 2, 10)


def test_scores_beyond_64_bits(spark):
    """1000 * a * n and l * r pass 2^63; the quotient is exact."""
    a, n, left, right = 9_000_000_000_123, 70_000_000_000_457, 9_500_000_000_201, 9_700_000_000_303
    counts = spark.createDataFrame([("en", 2, "x y", a), ("en", 1, "x", left), ("en", 1, "y", right)], "lang string, k int, gram string, n bigint")
    got = collocations.rank_candidates(counts, spark.createDataFrame([("en", n)], "lang string, n bigint"), 5).collect()
    assert [r.score for r in got] == [1000 * a * n // (left * right)]
