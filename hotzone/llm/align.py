"""Operator 13: alignment of two tokenizers by token-byte incidence matrices.

Each tokenizer's tokens and the bytes they cover form a 0/1 matrix in
compressed rows, built by hand. Gustavson's row products of one with the other
transposed give the overlap links of a text; the offsets where both end a
token cut the tokens into groups, and the product of the group incidences
gives the shared-group links.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hotzone.llm.common import register, ship, table, written

ship(__name__)

#: Texts are aligned together up to so many characters (one longer text alone).
BLOCK_CHARS = 1 << 20
#: A product is formed in runs of rows with about so many entries.
PRODUCT_ENTRIES = 1 << 22


class Rows(NamedTuple):
    """A 0/1 matrix in compressed rows: the columns of row i are ``cols[start[i]:start[i + 1]]``."""

    start: np.ndarray
    cols: np.ndarray


def spans_matrix(lengths: np.ndarray) -> Rows:
    """Token by byte: each token covers the bytes after those of the tokens before it."""
    start = np.concatenate([[0], np.cumsum(lengths)])
    return Rows(start, np.arange(start[-1]))


def transposed(m: Rows, n_cols: int) -> Rows:
    """Counting sort of the entries by column; rows stay in order within a column."""
    row = np.repeat(np.arange(len(m.start) - 1), np.diff(m.start))
    start = np.concatenate([[0], np.cumsum(np.bincount(m.cols, minlength=n_cols))])
    order = np.argsort(m.cols, kind="stable") if (np.diff(m.cols) < 0).any() else slice(None)
    return Rows(start, row[order])


def product(a: Rows, b: Rows, n_cols: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``row, col, value`` of a·b, in runs of rows.

    Row i of the product is the sum of the rows of b named by row i of a
    (Gustavson); equal columns of a row are merged by their count.
    """
    size = np.diff(b.start)[a.cols]
    grown = np.concatenate([[0], np.cumsum(size)])
    per_row = grown[a.start]
    lo = 0
    while lo < len(a.start) - 1:
        hi = max(lo + 1, int(np.searchsorted(per_row, per_row[lo] + PRODUCT_ENTRIES, "right")) - 1)
        e0, e1 = a.start[lo], a.start[hi]
        n = size[e0:e1]
        at = np.arange(grown[e1] - grown[e0]) + np.repeat(b.start[a.cols[e0:e1]] - (grown[e0:e1] - grown[e0]), n)
        row = np.repeat(np.repeat(np.arange(lo, hi), np.diff(a.start[lo:hi + 1])), n)
        key = row * n_cols + b.cols[at]
        if (np.diff(key) < 0).any():
            key.sort()
        if len(key):
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            yield key[first] // n_cols, key[first] % n_cols, np.diff(np.append(first, len(key)))
        lo = hi


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in own}
    letters.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))})
    return letters


class ByteBpe:
    """A byte-level vocabulary: ids of ``space + text``, and each id's bytes.

    The vocabulary is run by ``tiktoken``, which gives the same ids as the
    tokenizer's own library several times faster; texts that it refuses (very
    long runs of white space) go to that library.
    """

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        letters = byte_letters()
        self.bytes = [b""] * self.slow.get_vocab_size()
        plain = self.slow.get_vocab(with_added_tokens=False)
        special = {i for i, t in self.slow.get_added_tokens_decoder().items() if t.special}
        for token, i in self.slow.get_vocab().items():
            self.bytes[i] = token.encode() if i in special else bytes(letters[c] for c in token)
        ranks = {self.bytes[i]: i for i in plain.values() if i not in special}
        self.fast = tiktoken.Encoding("own", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(" " + text)
        except BaseException as e:  # a refusal of the Rust library is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            return self.slow.encode(" " + text, add_special_tokens=False).ids


class PieceBpe:
    """A sentence-piece vocabulary: ids of a text (the model adds the space), and each id's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(map(self.model.id_to_piece, range(n)))]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


def pair_universe(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """All id pairs ``a * len(b) + b`` that can end together, sorted.

    Tokens that end at the same byte have one the other's ending, so there are
    at most as many pairs as the two vocabularies have bytes (times equal
    tokens): the bound of everything that is counted or broadcast per pair.
    """
    of_a, of_b = defaultdict(list), defaultdict(list)
    for ids, tokens in ((of_a, a), (of_b, b)):
        for i, t in enumerate(tokens):
            if t:
                ids[t].append(i)
    keys = {x * len(b) + y for y, t in enumerate(b) for k in range(len(t)) for x in of_a.get(t[k:], ())}
    keys.update(x * len(b) + y for x, t in enumerate(a) for k in range(1, len(t)) for y in of_b.get(t[k:], ()))
    return np.array(sorted(keys), np.int64)


class Aligned(NamedTuple):
    """Texts aligned together; tokens, bytes and groups are numbered through all of them."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    token_a: Rows        # token by byte
    token_b: Rows
    link_a: np.ndarray   # positions of the pairs that end together
    link_b: np.ndarray
    group_a: np.ndarray  # group of each token
    group_b: np.ndarray
    doc_a: np.ndarray    # first token of each text, and the number of all
    doc_b: np.ndarray
    doc_group: np.ndarray
    overlaps: np.ndarray  # overlap links of each text

    def overlap_links(self):
        """``a, b, bytes``: token pairs that share bytes."""
        return product(self.token_a, transposed(self.token_b, len(self.token_b.cols)), len(self.ids_b))

    def group_links(self):
        """``a, b, 1``: token pairs of one group."""
        in_group = lambda g: Rows(np.arange(len(g) + 1), g)
        return product(in_group(self.group_a), transposed(in_group(self.group_b), int(self.doc_group[-1])), len(self.ids_b))


class Aligner:
    """Two tokenizers in one task."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteBpe(path_a), PieceBpe(path_b)
        self.len_a = np.array([len(x) for x in self.a.bytes])
        self.len_b = np.array([len(x) for x in self.b.bytes])
        number = lambda n, ends: [f"{i}{e}".encode() for e in ends for i in range(n)]
        self.text = np.array(number(len(self.len_a), (",", "|")) + number(len(self.len_b), (",", ";", "")), object)

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids by both; none where a vocabulary does not give the bytes of space + text."""
        if not text:
            return [], []
        src = (" " + text).encode()
        ids = self.a.encode(text), self.b.encode(text)
        for i, v in zip(ids, (self.a, self.b)):
            if b"".join(map(v.bytes.__getitem__, i)) != src:
                return [], []
        return ids

    def align(self, texts: list[str | None]) -> Aligned:
        pairs = [self.tokens(t) for t in texts]
        flat, first = [], []
        for side in (0, 1):
            n = [len(p[side]) for p in pairs]
            first.append(np.concatenate([[0], np.cumsum(n, dtype=np.int64)]))
            flat.append(np.fromiter(chain.from_iterable(p[side] for p in pairs), np.int64, int(first[-1][-1])))
        token_a, token_b = spans_matrix(self.len_a[flat[0]]), spans_matrix(self.len_b[flat[1]])
        end_a, end_b = token_a.start[1:], token_b.start[1:]
        link_a, link_b, overlaps = [], [], np.zeros(len(first[0]), np.int64)
        for x, y, _ in product(token_a, transposed(token_b, len(token_b.cols)), max(1, len(flat[1]))):
            overlaps[:-1] += np.diff(np.searchsorted(x, first[0], "left"))
            both = end_a[x] == end_b[y]
            link_a.append(x[both])
            link_b.append(y[both])
        none = [np.zeros(0, np.int64)]
        link_a, link_b = np.concatenate(link_a or none), np.concatenate(link_b or none)
        cuts = end_a[link_a]
        group_a, group_b = np.searchsorted(cuts, end_a, "left"), np.searchsorted(cuts, end_b, "left")
        doc_group = np.searchsorted(link_a, first[0], "left")
        return Aligned(flat[0], flat[1], token_a, token_b, link_a, link_b, group_a, group_b, first[0], first[1], doc_group, overlaps[:-1])

    def digests(self, m: Aligned) -> list[str]:
        """Per text the hash of its groups, ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
        n_groups = int(m.doc_group[-1])
        upto_a = np.cumsum(np.bincount(m.group_a, minlength=n_groups))
        upto_b = np.cumsum(np.bincount(m.group_b, minlength=n_groups))
        before_b = np.concatenate([[0], upto_b])
        last_a = np.arange(1, len(m.ids_a) + 1) == upto_a[m.group_a]
        last_b = (np.arange(1, len(m.ids_b) + 1) == upto_b[m.group_b]).astype(np.int64)
        ends = m.doc_b[1:][np.diff(m.doc_b) > 0] - 1
        last_b[ends] = 2
        codes = np.empty(len(m.ids_a) + len(m.ids_b), np.int64)
        codes[np.arange(len(m.ids_a)) + before_b[m.group_a]] = m.ids_a + len(self.len_a) * last_a
        codes[np.arange(len(m.ids_b)) + upto_a[m.group_b]] = 2 * len(self.len_a) + m.ids_b + len(self.len_b) * last_b
        words = self.text[codes].tolist()
        at = (m.doc_a + m.doc_b).tolist()
        return [hashlib.sha256(b"".join(words[s:e])).hexdigest() if e > s else "" for s, e in zip(at, at[1:])]


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BLOCK_CHARS characters."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > lo and size + n > BLOCK_CHARS:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links,
    n_overlaps, n_shared, groups_sha256, n_best, count_sum``.

    ``n_links`` counts token pairs that end together, ``n_overlaps`` pairs that
    share bytes, ``n_shared`` pairs of one group. ``n_best`` counts the links
    whose id pair is linked as often, in all of ``docs``, as any pair of its B
    id; ``count_sum`` adds the corpus-wide counts up over the links.

    Texts that are null or empty, or that a vocabulary does not reproduce byte
    by byte, have no tokens: zeros and ''. Rows are handled one by one, whatever
    their ids; repeated rows count as often as they occur; other columns are
    ignored; an empty table gives no rows. A text's memory is linear in its
    length. The links are written once as numbers of their id pair (four bytes
    each); the pairs that can be linked are bounded by the vocabularies
    (:func:`pair_universe`), so their counts are broadcast.
    """
    spark = docs.sparkSession
    a, b = ByteBpe(path_a), PieceBpe(path_b)
    n_b = len(b.bytes)
    universe = pair_universe(a.bytes, b.bytes)
    shared = spark.sparkContext.broadcast(universe)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_shared"]
    id_field = docs.select(F.col(doc_id).alias("doc_id")).schema[0]
    numbers = [T.StructField(n, T.LongType()) for n in names]
    sha = T.StructField("groups_sha256", T.StringType())
    schema = T.StructType([id_field, *numbers, sha, T.StructField("pairs", T.BinaryType())])

    def run(batches):
        aligner = None
        for batch in batches:
            aligner = aligner or Aligner(path_a, path_b)
            pairs_of = shared.value
            texts = batch.column(1).to_pylist()
            cols: list[list] = [[] for _ in range(8)]
            for lo, hi in blocks(texts):
                m = aligner.align(texts[lo:hi])
                number = np.searchsorted(pairs_of, m.ids_a[m.link_a] * n_b + m.ids_b[m.link_b]).astype("<i4")
                sizes = np.bincount(m.group_a, minlength=int(m.doc_group[-1])) * np.bincount(m.group_b, minlength=int(m.doc_group[-1]))
                total = np.concatenate([[0], np.cumsum(sizes)])
                groups = np.diff(m.doc_group)
                for c, v in zip(cols, (np.diff(m.doc_a), np.diff(m.doc_b), groups, groups, m.overlaps, np.diff(total[m.doc_group]))):
                    c.append(v)
                cols[6] += aligner.digests(m)
                cols[7] += [number[s:e].tobytes() for s, e in zip(m.doc_group, m.doc_group[1:])]
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(np.concatenate(c or none)) for c in cols[:6]], pa.array(cols[6], pa.string()), pa.array(cols[7], pa.binary())],
                names=schema.names)

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = written(src.mapInArrow(run, schema), "aligned")

    def count(batches):
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            numbers = [np.frombuffer(x.as_buffer(), "<i4") for x in batch.column(0)]
            total += np.bincount(np.concatenate(numbers or [np.zeros(0, "<i4")]), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    found = rows.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(universe), np.int64)
    counts[found["pair"].to_numpy()] = found["n"].to_numpy()
    best = np.zeros(n_b, np.int64)
    np.maximum.at(best, universe % n_b, counts)
    known = spark.sparkContext.broadcast((counts, counts == best[universe % n_b]))
    out = T.StructType([id_field, *numbers, sha, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def look_up(batches):
        n, top = known.value
        for batch in batches:
            ids = [np.frombuffer(x.as_buffer(), "<i4") for x in batch.column("pairs")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([int(top[i].sum()) for i in ids], pa.int64()), pa.array([int(n[i].sum()) for i in ids], pa.int64())],
                names=out.names)

    return rows.mapInArrow(look_up, out)


def token_links(docs: DataFrame, path_a: str, path_b: str, kind: str = "overlap", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The links themselves: ``doc_id, a, b, id_a, id_b, value`` (token positions
    and ids), one row per link. ``kind`` is ``overlap`` (value: shared bytes) or
    ``group`` (value 1). Products are formed in bounded runs of rows."""
    if kind not in ("overlap", "group"):
        raise ValueError("kind is overlap or group")
    id_field = docs.select(F.col(doc_id).alias("doc_id")).schema[0]
    schema = T.StructType([id_field] + [T.StructField(n, T.LongType()) for n in ("a", "b", "id_a", "id_b", "value")])

    def run(batches):
        aligner = None
        for batch in batches:
            aligner = aligner or Aligner(path_a, path_b)
            texts = batch.column(1).to_pylist()
            for lo, hi in blocks(texts):
                m = aligner.align(texts[lo:hi])
                for x, y, v in (m.overlap_links() if kind == "overlap" else m.group_links()):
                    doc = np.searchsorted(m.doc_a, x, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(doc + lo)), pa.array(x - m.doc_a[doc]), pa.array(y - m.doc_b[doc]),
                         pa.array(m.ids_a[x]), pa.array(m.ids_b[y]), pa.array(v)], names=schema.names)

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, schema)


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@register("op13_cross_tokenizer_alignment")
def op13_cross_tokenizer_alignment(spark, sf_dir):
    """All documents aligned between the byte-level and the piece vocabulary."""
    return align(table(spark, sf_dir, "documents"), byte_bpe(), piece_bpe())
