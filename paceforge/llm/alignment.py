"""Alignment of two tokenizers over the same bytes, in Arrow within tasks and merged by Spark.

A chunk of documents is one Arrow computation: lists of token ids are flattened with their
parent indices, token byte lengths are summed up segment by segment (cumulative sums less
the sum at the document's start), and an Acero full outer hash join on document-end keys
brings together the ends of both tokenizers. In the order of the keys each row of the join is
one overlapping pair of tokens: the token that ends there, and on a side where none ends the next one
that does. Rows with an end on both sides close a group.

``Table.group_by`` counts the pairs of each document and of the chunk. Spark adds the
chunks' counts up, finds the highest of each B id, and sends every chunk only the counts of its own pairs;
a cogroup by chunk makes the documents' sums. Nothing is broadcast but the vocabularies, and
texts are encoded once.

Both tokenizers cut before a space that follows no white space, whatever stands around it:
the byte-level pattern has no token with an inner space after another character, and no piece
of B holds its space mark after another character (checked when the model is loaded; else
texts are encoded whole). So each distinct stretch between such places is encoded once.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceforge.llm.common import written

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
KEPT_UNITS = 400_000
DOC_SHIFT = 40  # a document-end key is the document's place in the chunk and the byte offset of an end


def byte_level_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write the 256 bytes: printable Latin-1 for itself, the rest from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoders:
    """Both tokenizers, the bytes of their tokens, and a memory of stretches already encoded."""

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(byte_bpe.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        alphabet = byte_level_alphabet()
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.byte_sizes = [np.array([len(b) for b in x], np.int64) for x in (self.a_bytes, self.b_bytes)]
        self.by_stretch = all(MARK not in p.lstrip(MARK) for p in pieces)
        self.space = self.b.piece_to_id(MARK)
        self.known: dict[bytes, int] = {}  # a stretch's place in what follows
        self.lists = [_lists([], [])] * 2
        self.same = np.zeros(0, bool)

    def encoded(self, units: list[bytes], texts: list[str]) -> tuple[list, np.ndarray]:
        """The lists of ids of A and B of some stretches, and which of them both give back."""
        b_ids = self.b.encode([t[1:] for t in texts], num_threads=1)
        b_ids = [ids if len(t) > 1 else [self.space] for ids, t in zip(b_ids, texts, strict=True)]
        both, lists, same = ([e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], b_ids), [], np.ones(len(units), bool)
        for ids, table, sizes in zip(both, (self.a_bytes, self.b_bytes), self.byte_sizes, strict=True):
            flat, counts = list(chain.from_iterable(ids)), [len(x) for x in ids]
            lists.append(_lists(flat, counts))
            # the same bytes in all, cut at the same places
            ends = np.cumsum(np.append(0, sizes[flat]))[np.cumsum(counts)]
            if not (np.array_equal(ends, np.cumsum([len(u) for u in units])) and b"".join([table[i] for i in flat]) == b"".join(units)):
                same &= [b"".join([table[i] for i in x]) == u for x, u in zip(ids, units, strict=True)]
        return lists, same

    def units(self, units: list[bytes]) -> np.ndarray:
        """The places of stretches, all different, in ``lists`` and ``same``, which hold good until the next call."""
        import pyarrow as pa

        if len(self.known) > KEPT_UNITS:  # the stretches of this call stay
            stay = [u for u in units if u in self.known]
            places = np.array([self.known[u] for u in stay], np.int64)
            self.known, self.lists, self.same = {u: i for i, u in enumerate(stay)}, [x.take(pa.array(places)) for x in self.lists], self.same[places]
        new = [u for u in units if u not in self.known]
        texts = [u.decode("utf-8", "replace") for u in new]
        parts = [self.encoded(new[at : at + 4096], texts[at : at + 4096]) for at in range(0, len(new), 4096)]
        if parts:
            self.lists = [pa.concat_arrays([x, *(lists[w] for lists, _ in parts)]) for w, x in enumerate(self.lists)]
            self.same = np.concatenate([self.same, *(same for _, same in parts)])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))

    def given_back(self, places: np.ndarray, text: bytes) -> bool:
        """Whether both tokenizers' ids of the stretches at the places give the text's bytes."""
        ids = [x.take(places).flatten().to_pylist() for x in self.lists]
        return all(b"".join([table[i] for i in own]) == text for table, own in zip((self.a_bytes, self.b_bytes), ids, strict=True))


def stretches(raw: np.ndarray, starts: np.ndarray, cut: bool) -> np.ndarray:
    """Starts of the stretches: where a document starts, and at spaces after something that surely is no white space."""
    new = np.zeros(len(raw), bool)
    if cut:
        before, second = np.roll(raw, 1), np.roll(raw, 2)
        blank = (before <= 0x20) | ((before >= 0x80) & np.isin(second, [0x80, 0x81, 0x9A])) | (second == 0xC2)
        new = (raw == 0x20) & ~blank
    new[starts] = True
    return np.flatnonzero(new)


def _lists(flat: list[int], counts: list[int]):
    """A list array of int32 from the items of all its lists and the number of each one's."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(np.array(flat, np.int32)))


class Aligner:
    """Aligns chunks of documents."""

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes):
        import pyarrow as pa

        pa.set_cpu_count(1)
        self.enc = Encoders(byte_bpe, piece_bpe)
        self.sizes = [pa.array(x) for x in self.enc.byte_sizes]
        self.shown = [pa.array([str(i) for i in range(len(x))]) for x in (self.enc.a_bytes, self.enc.b_bytes)]

    def tokens(self, lists, codes, unit_doc, which: int):
        """(ids, document-end keys) of one tokenizer over all documents of the chunk."""
        import pyarrow as pa
        import pyarrow.compute as pc

        per_unit = lists.take(codes)
        ids, parent = pc.list_flatten(per_unit), pc.list_parent_indices(per_unit)
        doc = unit_doc.take(parent)
        total = pc.cumulative_sum(self.sizes[which].take(ids))
        first = pc.not_equal(doc.slice(1), doc.slice(0, len(doc) - 1)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(np.concatenate([[True], first]))  # first token of each document
        base = np.concatenate([[0], total.to_numpy()])[at]
        base = pa.array(np.repeat(base, np.diff(np.append(at, len(ids)))))
        return ids, pc.add(pc.multiply(pc.cast(doc, pa.int64()), 1 << DOC_SHIFT), pc.subtract(total, base))

    def chunk(self, texts: list[bytes]) -> tuple[list[tuple], tuple[np.ndarray, ...]]:
        """Per document (n_a, n_b, n_groups, n_links, sha, pair places, pair counts), and the chunk's pairs (a, b, count)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        none = (0, 0, 0, 0, "", np.zeros(0, np.int32), np.zeros(0, np.int32))
        out: list[tuple] = [none] * len(texts)
        full = [i for i, t in enumerate(texts) if t]
        empty = np.zeros(0, np.int64)
        if not full:
            return out, (empty, empty, empty)
        lengths = np.array([len(texts[i]) + 1 for i in full])
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join([b" " + texts[i] for i in full]), np.uint8)
        at = stretches(raw, ends - lengths, self.enc.by_stretch)
        offsets = pa.array(np.append(at, len(raw)), pa.int64())
        units = pa.Array.from_buffers(pa.large_binary(), len(at), [None, offsets.buffers()[1], pa.py_buffer(raw.tobytes())]).dictionary_encode()
        codes = self.enc.units(units.dictionary.to_pylist())[units.indices.to_numpy()]
        unit_doc = np.searchsorted(ends, at, side="right")
        # documents whose bytes don't come back have no tokens
        odd = np.unique(unit_doc[~self.enc.same[codes]])
        lost = [d for d in odd.tolist() if not self.enc.given_back(codes[unit_doc == d], b" " + texts[full[d]])]
        if lost:
            stay = ~np.isin(unit_doc, lost)
            codes, unit_doc = codes[stay], unit_doc[stay]
        if not len(codes):
            return out, (empty, empty, empty)
        codes, unit_doc = pa.array(codes), pa.array(unit_doc, pa.int64())
        sides = [self.tokens(x, codes, unit_doc, w) for w, x in enumerate(self.enc.lists)]
        (a_ids, a_key), (b_ids, b_key) = sides
        count = lambda ids: pa.array(np.arange(len(ids), dtype=np.int32))
        left, right = pa.table({"key": a_key, "a_at": count(a_ids)}), pa.table({"key": b_key, "b_at": count(b_ids)})
        links = left.join(right, keys="key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
        key, a_at, b_at = (links.column(c).combine_chunks() for c in ("key", "a_at", "b_at"))
        both = pc.and_(pc.is_valid(a_at), pc.is_valid(b_at))
        doc = pc.shift_right(key, DOC_SHIFT).to_numpy()

        def joined(x, ids, which):
            """The ids of each group with commas; a group ends with the token that ends where one of the other side does."""
            cuts = np.concatenate([[0], x.filter(both).to_numpy() + 1]).astype(np.int32)
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), self.shown[which].take(ids)), ",")

        groups = pc.binary_join_element_wise(joined(a_at, a_ids, 0), joined(b_at, b_ids, 1), "|")
        group_doc = doc[both.to_numpy(zero_copy_only=False)]
        docs = np.unique(doc)
        spans = np.searchsorted(group_doc, np.append(docs, docs[-1] + 1)).astype(np.int32)
        written_out = pc.binary_join(pa.ListArray.from_arrays(pa.array(spans), groups), ";")

        pair = pc.bit_wise_or(pc.shift_left(pc.cast(a_ids.take(pc.fill_null_backward(a_at)), pa.int64()), 32), pc.cast(b_ids.take(pc.fill_null_backward(b_at)), pa.int64()))
        pair = pair.dictionary_encode()
        per_doc = pa.table({"doc": doc, "pair": pair.indices}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc")
        in_chunk = per_doc.group_by("pair", use_threads=False).aggregate([("count_all", "sum")]).sort_by("pair")
        names = pair.dictionary.to_numpy()
        place, n = per_doc["pair"].to_numpy().astype(np.int32), per_doc["count_all"].to_numpy().astype(np.int32)
        bounds = np.searchsorted(per_doc["doc"].to_numpy(), np.append(docs, docs[-1] + 1))
        sums = [np.bincount(np.asarray(pc.shift_right(k, DOC_SHIFT)), minlength=docs[-1] + 1)[docs] for k in (a_key, b_key)]
        n_links = np.bincount(doc, minlength=docs[-1] + 1)[docs]
        for i, d in enumerate(docs.tolist()):
            sha = hashlib.sha256(written_out[i].as_buffer()).hexdigest()
            s = slice(bounds[i], bounds[i + 1])
            out[full[d]] = int(sums[0][i]), int(sums[1][i]), int(spans[i + 1] - spans[i]), int(n_links[i]), sha, place[s], n[s]
        return out, (names >> 32, names & 0xFFFFFFFF, in_chunk["count_all_sum"].to_numpy())


def align_chunks(rows: DataFrame, byte_bpe: bytes, piece_bpe: bytes, chunk_bytes: int) -> DataFrame:
    """A row for each document with its pairs by their place in the chunk's list, and a row for each chunk with that list."""
    files = rows.sparkSession.sparkContext.broadcast((byte_bpe, piece_bpe))  # two vocabularies

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        aligner, number = Aligner(*files.value), TaskContext.get().partitionId() << 32
        kinds = {"chunk": pa.int64(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string()}
        lists = {"place": pa.list_(pa.int32()), "n": pa.list_(pa.int32()), "pair_a": pa.list_(pa.int64()), "pair_b": pa.list_(pa.int64()), "pair_n": pa.list_(pa.int64())}
        schema = pa.schema([*kinds.items(), *lists.items()])

        def flush(ids: list, texts: list[bytes]) -> Iterator:
            nonlocal number
            docs, pairs = aligner.chunk(texts)
            cols = list(zip(*docs, strict=True))
            for at in range(0, len(ids), 512):
                s = slice(at, at + 512)
                n = len(ids[s])
                plain = [pa.array([number] * n, pa.int64()), pa.array(ids[s], pa.int64()), *(pa.array(c[s], k) for c, k in zip(cols[:5], list(kinds.values())[2:], strict=True))]
                yield pa.RecordBatch.from_arrays([*plain, *(pa.array(list(c[s]), pa.list_(pa.int32())) for c in cols[5:]), *(pa.nulls(n, k) for k in list(lists.values())[2:])], schema=schema)
            if len(pairs[0]):
                own = [pa.array([number], pa.int64()), *(pa.nulls(1, k) for k in [*list(kinds.values())[1:], *list(lists.values())[:2]]), *(pa.array([p.astype(np.int64)], pa.list_(pa.int64())) for p in pairs)]
                yield pa.RecordBatch.from_arrays(own, schema=schema)
            number += 1

        ids, texts, size = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids.append(i)
                    texts.append(t)
                    size += len(t)
                    if size >= chunk_bytes:
                        yield from flush(ids, texts)
                        ids, texts, size = [], [], 0
        if ids:
            yield from flush(ids, texts)

    return rows.mapInArrow(run, "chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, place array<int>, n array<int>, pair_a array<bigint>, pair_b array<bigint>, pair_n array<bigint>")


def _sum_counts(docs, counts):
    """Documents of one chunk with the sums over their links; counts has the corpus-wide count of each of the chunk's pairs."""
    import pyarrow as pa
    import pyarrow.compute as pc

    size = counts.num_rows
    total, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    at = counts.column("place").to_numpy()
    total[at], best[at] = counts.column("total").to_numpy(), counts.column("best").to_numpy()
    place = docs.column("place").combine_chunks()
    n, flat, of = pc.list_flatten(docs.column("n").combine_chunks()).to_numpy(), pc.list_flatten(place).to_numpy(), pc.list_parent_indices(place).to_numpy()
    sums = []
    for each in (best, total):
        out = np.zeros(docs.num_rows, np.int64)
        np.add.at(out, of, each[flat] * n)
        sums.append(pa.array(out))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return pa.table([*(docs.column(c) for c in names), *sums], names=[*names, "n_best", "count_sum"])


def aligned_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, chunk_bytes: int = 4 << 20) -> DataFrame:
    """The written table of ``align_chunks`` over all documents. Vocabulary files are read on the driver and sent with the job."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    with open(byte_bpe, "rb") as f, open(piece_bpe, "rb") as g:
        return written(align_chunks(rows, f.read(), g.read(), chunk_bytes))


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(a, b, total, best): how many links hold each pair of ids corpus-wide, and 1 if no pair of the same B id has more."""
    totals = _pairs(chunks).groupBy("a", "b").agg(F.sum("n").alias("total"))
    return totals.join(totals.groupBy("b").agg(F.max("total").alias("most")), "b").select("a", "b", "total", (F.col("total") == F.col("most")).cast("bigint").alias("best"))


def _pairs(chunks: DataFrame) -> DataFrame:
    listed = chunks.where("pair_a is not null").select("chunk", F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("place", "p"))
    return listed.select("chunk", "place", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").alias("n"))


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, chunk_bytes: int = 4 << 20) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes the text after a space, B adds its own. Links are all pairs of an A and a B token
    whose byte ranges overlap; groups lie between offsets where both have a token's end. n_best counts
    the links whose pair is the most frequent of its B id, count_sum adds up the corpus-wide
    counts of all links. Null or empty texts and those whose bytes one of the tokenizers doesn't give
    back (with U+2581, say) have no tokens: zeros and an empty digest. Repeated rows count as often
    as they come; a null id stays null; an empty table gives no rows; other columns are not read. A
    text is held whole in its task; chunks hold ``chunk_bytes`` and one text more at most.
    """
    chunks = aligned_chunks(docs, id_col, text_col, byte_bpe, piece_bpe, chunk_bytes)
    known = _pairs(chunks).join(pair_counts(chunks), ["a", "b"]).select(F.col("chunk").alias("of"), "place", "total", "best")
    texts = chunks.where("pair_a is null").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "place", "n")
    out = texts.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(_sum_counts, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
