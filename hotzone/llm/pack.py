"""Operator 2: pattern packing by non-negative least squares.

Token lengths are counted on the cluster. On that histogram (one count per
length, so bounded by the sequence length) few-document patterns are
enumerated over length bins, their repeat counts are fitted by non-negative
least squares and rounded, and what is left is packed best-fit. The plan is a
short list of runs; each piece then finds its place from its rank among the
pieces of its length.
"""

from __future__ import annotations

import itertools
import re
import struct
import unicodedata
import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hotzone.llm.common import register, ship, table, written

ship(__name__)

END_ID = 1
CACHE_CHUNKS = 400_000
TAIL = ".,!?;:"
#: precomposed Latin letters whose lower case is one letter
LATIN = "\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u0148\u014A-\u017E"
#: anything but printable ASCII, line feeds, those letters, and typographic dashes, quotes and dots
NOT_PLAIN = re.compile(rf"[^\n -~{LATIN}\u2013\u2014\u2018\u2019\u201C\u201D\u2022\u2026]")
#: the pre-tokenizer's pattern on plain texts, in either case
PIECE = re.compile(rf"[A-Za-z{LATIN}]+|'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL])|[0-9]|[^\n A-Za-z0-9{LATIN}]+")


class Parts(dict):
    """Token bytes by part of a text, made by ``make`` when asked for first."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, part: str) -> bytes:
        got = self.make(part)
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        if len(part) <= 64:
            self[part] = got
        return got


class Encoder:
    """Token ids of a text as little-endian uint32 bytes, equal to
    ``Tokenizer.encode(text, add_special_tokens=False)``.

    A text without a character of ``NOT_PLAIN`` is cut as the tokenizer's own
    pre-tokenizer cuts it (``PIECE``), and each piece goes to its model. Of
    other texts, and those that hold a special token, only this is used: the
    tokenizer drops white space and never joins characters across it, so they
    are encoded chunk by chunk (cut at spaces and line feeds), where a chunk
    of letters skips the normaliser. Pieces and chunks are cached up to a bound.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tokenize = self.tok.model.tokenize
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.pieces, self.chunks = Parts(self.piece), Parts(self.chunk)
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.chars = {b: chr(b) for b in keep}
        self.chars.update({b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(keep))})

    def full(self, chunk: str) -> bytes:
        return np.array(self.tok.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        form = piece.lower()
        if not form.isascii():
            form = "".join([self.chars[b] for b in form.encode()])
        ids = [t.id for t in self.tokenize(form)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def chunk(self, chunk: str) -> bytes:
        core = chunk.rstrip(TAIL)
        if core and core.lower().isalpha() and (core.isascii() or "Σ" not in core and unicodedata.is_normalized("NFC", chunk)):
            got = self.pieces[core.lower()]
            return got + self.pieces[chunk[len(core):]] if len(core) < len(chunk) else got
        return self.full(chunk)

    def encode(self, text: str) -> bytes:
        if NOT_PLAIN.search(text) is None and not any(t in text for t in self.special):
            return b"".join(map(self.pieces.__getitem__, PIECE.findall(text)))
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


def token_pieces(docs: DataFrame, tokenizer: str, max_len: int, doc_id: str, text: str, with_ids: bool) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32[, ids]``."""
    schema = T.StructType([
        docs.select(F.col(doc_id).alias("doc_id")).schema[0], T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def run(batches):
        enc = None
        for batch in batches:
            enc = enc or Encoder(tokenizer)
            src, cols = [], [[] for _ in schema.fields[1:]]
            texts = batch.column(1)
            for i in range(batch.num_rows):
                ids = enc.encode(texts[i].as_py() or "") + END_ID.to_bytes(4, "little")
                for p, at in enumerate(range(0, len(ids), 4 * max_len)):
                    part = ids[at:at + 4 * max_len]
                    src.append(i)
                    for c, v in zip(cols, (p, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        c.append(v)
            out = [batch.column(0).take(pa.array(src, pa.int64())), pa.array(cols[0], pa.int32()),
                   *[pa.array(c, pa.int64()) for c in cols[1:4]]]
            if with_ids:
                out.append(pa.array(cols[4], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def patterns(bins: int, depth: int) -> list[tuple[int, ...]]:
    """All multisets of 2 to ``depth`` bins (largest first) that add up to ``bins``."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int, most: int) -> None:
        if left <= most and head:
            out.append(head + (left,))
        if len(head) < depth - 1:
            for k in range(min(most, left - 1), 0, -1):
                grow(head + (k,), left - k, k)

    grow((), bins, bins - 1)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int) -> np.ndarray:
    """min |a x - b|, x >= 0, by the active-set method; at most one positive entry per row of ``a``."""
    x, on = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[on] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= 1e-9 * (1 + np.abs(b).max()):
            break
        on[j] = True
        while True:
            s = np.zeros_like(x)
            s[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (s[on] > 1e-12).all():
                break
            bad = on & (s <= 1e-12)
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            on &= x > 1e-12
            if not on.any():
                s = np.zeros_like(x)
                break
        x = s
    return x


#: shares of the fitted repeat counts that are tried; at 0 all pieces are residuals
SHARES = (1.0, 0.9, 0.75, 0.5, 0.0)


def plan_runs(hist: dict[int, int], max_len: int, depth: int = 4, bins: int = 64) -> np.ndarray:
    """Rows ``length, first rank, copies, first sequence, offset``, sorted.

    The pieces of a length with ranks from the first rank on fill sequences
    from the first one on, ``copies`` side by side in each, from ``offset``.

    The fitted repeat counts are rounded down at several shares of them, the
    pieces left over are packed best-fit decreasing, and the plan with the
    fewest sequences is taken, of equal ones that with the largest share. So it
    never needs more than best-fit decreasing alone.
    """
    width = -(-max_len // bins)
    size = -(-max_len // width)
    have = np.zeros(size + 1)
    for k, v in hist.items():
        if 0 < v and k < max_len:
            have[-(-k // width)] += v
    pats = patterns(size, depth)
    repeats: dict[tuple[int, ...], float] = {}
    if have.sum() > size and pats:
        a = np.zeros((size, len(pats)))
        for j, p in enumerate(pats):
            for k in p:
                a[k - 1, j] += 1
        x = nnls(a, have[1:], 3 * size)
        repeats = {pats[j]: float(x[j]) for j in np.flatnonzero(x)}
    best = None
    for share in SHARES if repeats else (0.0,):
        n_seq, rows = _runs(hist, max_len, width, {p: int(v * share + 1e-6) for p, v in repeats.items()})
        if best is None or n_seq < best[0]:
            best = n_seq, rows
    return np.array(sorted(best[1]), dtype=np.int64).reshape(-1, 5)


def best_fit(hist: list[tuple[int, int]], max_len: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Best-fit decreasing over (length, count), lengths falling: groups of
    alike sequences as (count, members (length, first of the rest, copies)).

    Of the sequences with room, a piece takes the one with the least, which
    keeps taking that length until none fits; so groups are dealt with whole,
    and a length splits at most two of them."""
    groups: dict[int, list[tuple[int, list[tuple[int, int, int]]]]] = {}  # by room left
    rooms: list[int] = []  # sorted

    def put(room: int, count: int, members: list[tuple[int, int, int]]) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((count, members))

    for length, n in hist:
        at = 0
        while n:
            k = bisect_left(rooms, length)
            if k == len(rooms):  # new sequences
                room, count, members = max_len, n, []
            else:
                room = rooms[k]
                count, members = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[k]
            copies = min(room // length, n)
            part = min(count, n // copies)
            if part < count and members:
                put(room, count - part, [(x, r + part * c, c) for x, r, c in members])
            put(room - copies * length, part, [*members, (length, at, copies)])
            at += part * copies
            n -= part * copies
    return [g for room in rooms for g in groups[room]]


def _runs(hist: dict[int, int], max_len: int, width: int, repeats: dict[tuple[int, ...], int]) -> tuple[int, list[tuple]]:
    """Sequences, and runs, of a plan that begins with the given repeats of patterns."""
    left = {k: v for k, v in hist.items() if v > 0}
    lens = sorted(left)
    taken: dict[int, int] = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    n_seq = 0

    def take(length: int, n: int) -> int:
        at = taken[length]
        taken[length] += n
        left[length] -= n
        if not left[length]:
            lens.pop(bisect_right(lens, length) - 1)
        return at

    def fill(count: int, members: list[tuple[int, int, int]], used: int) -> None:
        """``count`` sequences that begin alike are topped up, best fit first."""
        nonlocal n_seq
        work = [(count, members, used)]
        while work:
            count, members, used = work.pop()
            k = bisect_right(lens, max_len - used)
            if k == 0:
                off = 0
                for length, at, copies in members:
                    rows.append((length, at, copies, n_seq, off))
                    off += length * copies
                n_seq += count
                continue
            length = lens[k - 1]
            copies = min((max_len - used) // length, left[length])
            part = min(count, left[length] // copies)
            if part < count:
                rest = [(x, at + part * c, c) for x, at, c in members]
                work.append((count - part, rest, used))
            at = take(length, part * copies)
            work.append((part, members + [(length, at, copies)], used + length * copies))

    for pattern in sorted((p for p, n in repeats.items() if n), reverse=True):
        todo = repeats[pattern]
        while todo:  # the last slot of a pattern is filled best-fit, by exact length
            heads = []
            for k in pattern[:-1]:
                i = bisect_right(lens, k * width) - 1
                if i < 0 or lens[i] <= (k - 1) * width:
                    break
                heads.append(lens[i])
            if len(heads) < len(pattern) - 1:
                break
            need = {h: heads.count(h) for h in heads}
            n = min([todo, *(left[h] // c for h, c in need.items())])
            if n == 0:
                n, heads = 1, list(itertools.islice(heads, 1))
            members = [(h, take(h, n), 1) for h in heads]
            fill(n, members, sum(heads))
            todo -= n
    base = dict(taken)
    for count, members in best_fit([(k, left[k]) for k in reversed(lens)], max_len):
        off = 0
        for length, at, copies in members:
            rows.append((length, base[length] + at, copies, n_seq, off))
            off += length * copies
        n_seq += count
    return n_seq, rows


def pack(docs: DataFrame, tokenizer: str, max_len: int = 4096, doc_id: str = "doc_id", text: str = "text",
         depth: int = 4, with_ids: bool = False) -> DataFrame:
    """Place every document's tokens (then id 1) in sequences of at most
    ``max_len``: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``
    and, if asked for, ``ids`` (uint32 bytes).

    Only longer documents are cut. Null texts count as empty (one token). Rows
    with repeated or null ids are packed one by one, ties in any order; an
    empty table gives no rows; other columns of docs are ignored. The pieces
    are written once. Ranks within a length are taken in hash buckets, as many
    as there are shuffle partitions, so one hot length is spread over them.
    """
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, tokenizer, max_len, doc_id, text, with_ids), "pieces")
    hist = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # <= max_len rows
    plan = spark.sparkContext.broadcast(plan_runs(hist, max_len, depth))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    b = pieces.withColumn("b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = (b.groupBy("length", "b").count().withColumn("base", F.sum("count").over(
        Window.partitionBy("length").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "b", F.coalesce("base", F.lit(0)).alias("base")))
    order = Window.partitionBy("length", "b").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (b.withColumn("n", F.row_number().over(order) - 1).join(before, ["length", "b"])
              .select(*pieces.columns, (F.col("base") + F.col("n")).alias("rank")))
    schema = T.StructType(pieces.schema.fields + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        p = plan.value
        starts = (p[:, 0] << 44) + p[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            r = p[np.searchsorted(starts, (length << 44) + rank, side="right") - 1]
            d = rank - r[:, 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in schema.names[:-2]] + [pa.array(r[:, 3] + d // r[:, 2]), pa.array(r[:, 4] + d % r[:, 2] * length)],
                names=schema.names)

    return ranked.mapInArrow(place, schema)


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register("op2_best_fit_packing")
def op2_best_fit_packing(spark, sf_dir):
    """All documents packed into sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"), word_bpe())
