"""Token counts by section, from one encoding of each whole document.

Encoding sections one by one gives other tokens than encoding the document, since
merges cross the borders. So the rendered document (its fields joined by a
separator) is encoded once; the byte lengths of its tokens give every token's span,
and an interval join of token spans with section spans tells whose token it is.
Tokens that cross a border are allocated by a rule:

start      to the section that holds the token's first byte
end        to the section that holds its last byte
majority   to the section that holds most of its bytes, the earlier one on a tie
fraction   to every section it touches, by its share of the token's bytes
"""

from __future__ import annotations

import base64
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceforge.llm.common import map_rows

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RULES = ("start", "end", "majority", "fraction")


def encoder(path: str):
    """A byte-level BPE from a file of ranks, and the byte length of each token."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens per section. Both inputs are the end offsets of spans that tile the same bytes.

    Empty sections get nothing. The interval join works on sorted ends, so it is linear
    in tokens plus sections.
    """
    k = len(section_ends)
    out = np.zeros(k)
    if not len(token_ends):
        return out
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    if rule in ("start", "end"):
        return np.bincount(first if rule == "start" else last, minlength=k).astype(float)
    inside = first == last
    out += np.bincount(first[inside], minlength=k)
    for a, b, i, j in zip(starts[~inside], token_ends[~inside], first[~inside], last[~inside], strict=True):
        low = np.concatenate([[0], section_ends])[i : j + 1]
        share = np.minimum(b, section_ends[i : j + 1]) - np.maximum(a, low)
        if rule == "fraction":
            out[i : j + 1] += share / (b - a)
        else:
            out[i + int(np.argmax(share))] += 1
    return out


def sections(fields: Sequence[str], separator: str, by_line: str | None, names: Sequence[str]) -> tuple[str, list[tuple[str, int, int]]]:
    """The rendered text and (field, number, length in bytes) of its sections; a separator or line end belongs to what it ends."""
    parts: list[tuple[str, int, str]] = []
    for i, (name, value) in enumerate(zip(names, fields, strict=True)):
        pieces = value.split("\n") if name == by_line else [value]
        for j, piece in enumerate(pieces):
            tail = "\n" if j + 1 < len(pieces) else separator if i + 1 < len(names) else ""
            parts.append((name, j, piece + tail))
    return "".join(p[2] for p in parts), [(n, j, len(p.encode("utf-8", "surrogatepass"))) for n, j, p in parts]


def section_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    fields: Sequence[str] = ("lang", "source", "text"),
    by_line: str | None = "text",
    separator: str = "\n",
    rule: str = "start",
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """One row per document and section: doc_id, field, section, n_bytes, n_tokens, doc_tokens.

    ``by_line`` names the field whose lines are sections of their own. Null fields are
    empty; an empty field or line is a section whose only bytes are its separator, the
    last one none. n_tokens of a document's sections add up to doc_tokens under every
    rule. Repeated rows give repeated results; a null id stays null. ``vocabulary`` is a
    file of ranks that every worker can read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    fields = list(fields)
    rows = docs.select(F.col(id_col).alias("id"), *(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{i}") for i, f in enumerate(fields)))
    kind = dict(rows.dtypes)["id"]

    def start():
        enc, sizes = encoder(vocabulary)

        def one(r):
            text, spans = sections([r[f"f{i}"] for i in range(len(fields))], separator, by_line, fields)
            ids = np.array(enc.encode_ordinary(text), np.int64)
            counts = attribute(np.cumsum(sizes[ids]), np.cumsum([s[2] for s in spans]), rule)
            for (name, number, size), n in zip(spans, counts.tolist(), strict=True):
                yield r["id"], name, number, size, n, len(ids)

        return one

    return map_rows(rows, f"doc_id {kind}, field string, section bigint, n_bytes bigint, n_tokens double, doc_tokens bigint", start)
