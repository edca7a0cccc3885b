"""Operator 12: personal data by offset-preserving deobfuscation.

Two transducers rewrite a text and remember where every piece came from: the
first undoes homoglyphs, invisible characters, character references, bracketed
at/dot and spelled digits, the second undoes bare "at" and "dot" words. The
detectors run on the text itself and on its rewritten form; spans found there
are mapped back to the source characters.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hotzone.llm.common import register, ship, table

ship(__name__)

KINDS = ("email", "ip", "card", "phone")
SPAN = "array<struct<kind:string,start:int,end:int,added:boolean>>"

# --- fixed values ---------------------------------------------------------
# Letters of other scripts that look like a Latin letter, and marks that look like a dot or a hyphen.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ӏ": "l",
    "。": ".", "‧": ".", "·": ".",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
}
INVISIBLE = "\u00ad\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"
AT = "at|arroba|arobase"
DOT = "dot|punkt|point|punto"
DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
# --------------------------------------------------------------------------

#: So many digit words in a row, at least, are read as digits.
MIN_DIGIT_WORDS = 3


@lru_cache(maxsize=1)
def single_chars() -> dict[str, str]:
    """Characters that stand for one ASCII character: the look-alikes, decimal
    digits of all scripts, and whatever compatibility normalisation maps to one;
    invisible ones stand for nothing."""
    to = {}
    for code in [*range(0xA0, 0x3400), *range(0xA620, 0xABFA), *range(0xFE30, 0x11A00), *range(0x1D400, 0x1D800), *range(0x1E140, 0x1E960), *range(0x1FBF0, 0x1FBFA)]:
        c = chr(code)
        digit = unicodedata.decimal(c, None)
        form = str(digit) if digit is not None else unicodedata.normalize("NFKC", c)
        if len(form) == 1 and " " <= form <= "~":
            to[c] = form
    to.update(LOOKALIKES)
    to.update(dict.fromkeys(INVISIBLE, ""))
    return to


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++)+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def emails(t: str):
    """Leftmost matches in linear time: a match has one @, and begins where the
    characters allowed before it begin, but not before the last match's end."""
    end, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > end and t[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(t, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = t.find("@", max(at + 1, end))


def addresses(t: str):
    """Four numbers at a time out of every chain of dotted numbers."""
    for m in CHAIN.finditer(t):
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def cards(t: str):
    for m in CARD.finditer(t):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(t: str):
    if "+" in t:
        for m in PHONE.finditer(t):
            if 10 <= len(DIGIT.findall(m.group())) <= 15:
                yield m.span()


DETECT = {"email": emails, "ip": addresses, "card": cards, "phone": phones}


class Rewritten:
    """A text after edits ``(start, end, replacement)``, in order and apart from
    each other, and the way back: each edit's place before and after."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        out, at, size = [], 0, 0
        self.starts: list[int] = []
        self.edits: list[tuple[int, int, int]] = []
        for s, e, r in edits:
            out += (text[at:s], r)
            size += s - at
            self.starts.append(size)
            size += len(r)
            self.edits.append((size, s, e))
            at = e
        out.append(text[at:])
        self.text = "".join(out)

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of the rewritten characters ``start`` to ``end``."""
        return self._at(start)[0], self._at(end - 1)[1]

    def _at(self, pos: int) -> tuple[int, int]:
        k = bisect_right(self.starts, pos) - 1
        if k < 0:
            return pos, pos + 1
        after, s, e = self.edits[k]
        return (s, e) if pos < after else (e + pos - after, e + pos - after + 1)


BRACKETED = re.compile(rf"[\[({{<]\s{{0,2}}(?:(?P<at>{AT}|@)|(?:{DOT}|\.))\s{{0,2}}[\])}}>]", re.IGNORECASE)
REFERENCE = re.compile(r"&(?:\#0{0,5}64|\#[xX]0{0,5}40|commat|\#0{0,5}46|\#[xX]0{0,5}2[eE]|period);")
AT_REFERENCE = re.compile(r"&(?:\#0*64|\#[xX]0*40|commat);")
APART = re.compile(r"(?<=\S)\s{1,3}@\s{1,3}(?=\S)")
WORD_DIGIT = {w: str(d) for line in DIGIT_WORDS for d, w in enumerate(line.split())}
ONE_DIGIT = "(?:" + "|".join(sorted(WORD_DIGIT, key=len, reverse=True)) + ")"
SPELLED = re.compile(rf"(?:(?<!\w)plus[\s-]{{1,3}})?(?<!\w){ONE_DIGIT}(?:[\s-]{{1,3}}{ONE_DIGIT}(?!\w)){{{MIN_DIGIT_WORDS - 1},}}", re.IGNORECASE)
DIGIT_WORD = re.compile(r"\w+")
DIGIT_ENDS = tuple(WORD_DIGIT)
AT_WORDS, DOT_WORDS = AT.split("|"), DOT.split("|")
LABEL = r"[A-Za-z0-9-]+"
BARE = re.compile(rf"(?<=[A-Za-z0-9_%+-])\s{{1,3}}(?:{AT})\s{{1,3}}(?={LABEL}(?:\.{LABEL})*\s{{1,3}}(?:{DOT})\s{{1,3}}[A-Za-z]{{2}})", re.IGNORECASE)
BARE_DOT = re.compile(rf"({LABEL}(?:\.{LABEL})*)(\s{{1,3}}(?:{DOT})\s{{1,3}})(?=[A-Za-z0-9])", re.IGNORECASE)
IP_WORDS = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:\s{{1,3}}(?:{DOT})\s{{1,3}}[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)
DOT_WORD = re.compile(rf"\s{{1,3}}(?:{DOT})\s{{1,3}}", re.IGNORECASE)
LAST_DOT = re.compile(rf"(?:^|\s)(?:{DOT})$", re.IGNORECASE)


def _apart(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """In order, without those that overlap an earlier one."""
    out, at = [], 0
    for e in sorted(edits):
        if e[0] >= at:
            out.append(e)
            at = e[1]
    return out


def characters(t: str) -> list[tuple[int, int, str]]:
    """Edits of single characters: homoglyphs and invisible ones."""
    if t.isascii():
        return []
    to = single_chars()
    have = to.keys() & set(t)
    if not have:
        return []
    return [(m.start(), m.end(), to[m.group()]) for m in re.finditer("[" + "".join(sorted(have)) + "]", t)]


def _spelled(t: str) -> bool:
    """Whether a run of digit words is possible: one of its inner words stands free."""
    words = t.lower().replace("-", " ").split()
    return any(w in WORD_DIGIT and words[i].endswith(DIGIT_ENDS) and words[i + 2].startswith(DIGIT_ENDS)
               for i, w in enumerate(words[1:-1]))


def marks(t: str) -> list[tuple[int, int, str]]:
    """Edits of bracketed at/dot, character references, an @ apart, and spelled digits."""
    edits = []
    for m in BRACKETED.finditer(t):
        s, e = m.span()
        while s > 0 and s > m.start() - 2 and t[s - 1].isspace():
            s -= 1
        while e < len(t) and e < m.end() + 2 and t[e].isspace():
            e += 1
        edits.append((s, e, "@" if m.group("at") else "."))
    if "&" in t:
        edits += [(*m.span(), "@" if AT_REFERENCE.match(m.group()) else ".") for m in REFERENCE.finditer(t)]
    if "@" in t:
        edits += [(*m.span(), "@") for m in APART.finditer(t)]
    if _spelled(t):
        for m in SPELLED.finditer(t):
            words = list(DIGIT_WORD.finditer(t, *m.span()))
            for k, w in enumerate(words):  # a word takes the separator before it along
                start = w.start() if k == 0 else words[k - 1].end()
                edits.append((start, w.end(), "+" if w.group().lower() == "plus" else WORD_DIGIT[w.group().lower()]))
    return _apart(edits)


def bare_words(t: str) -> list[tuple[int, int, str]]:
    """Edits of bare words: ``a dot b at c dot d``, if a dot word follows the at
    word's host, and four numbers with dot words between them."""
    edits, floor = [], 0
    low = t.lower()
    if not any(w in low for w in DOT_WORDS):
        return edits
    for m in BARE.finditer(t) if any(w in low for w in AT_WORDS) else ():
        if m.start() < floor:
            continue
        back = []
        end = m.start()
        while True:  # dot words of the local part, one by one
            s = end
            while s > floor and t[s - 1] in LOCAL:
                s -= 1
            g = s
            while g > floor and g > s - 3 and t[g - 1].isspace():
                g -= 1
            d = LAST_DOT.search(t, max(floor, g - 8), g) if g < s < end else None
            if not d:
                break
            w = g - len(d.group().strip())
            b = w
            while b > floor and b > w - 3 and t[b - 1].isspace():
                b -= 1
            if b == w or b <= floor or t[b - 1] not in LOCAL:
                break
            back.append((b, s, "."))
            end = b
        edits += back[::-1]
        edits.append((*m.span(), "@"))
        floor = m.end()
        while (d := BARE_DOT.match(t, floor)):
            edits.append((*d.span(2), "."))
            floor = d.end()
    for m in IP_WORDS.finditer(t):
        edits += [(*d.span(), ".") for d in DOT_WORD.finditer(t, *m.span())]
    return _apart(edits)


def find(text: str | None) -> list[tuple[str, int, int, bool]]:
    """``kind, start, end, added`` in order of start and kind; offsets count characters."""
    if not text:
        return []
    base = {k: list(DETECT[k](text)) for k in KINDS}
    spans = [(s, i, e, False) for i, k in enumerate(KINDS) for s, e in base[k]]
    steps = []
    now = text
    for step in (characters, marks, bare_words):
        edits = step(now)
        if edits:
            steps.append(Rewritten(now, edits))
            now = steps[-1].text
    if steps:
        for i, k in enumerate(KINDS):
            known = [s for s, _ in base[k]]
            for s, e in DETECT[k](now):
                for r in reversed(steps):
                    s, e = r.source(s, e)
                at = bisect_right(known, s) - 1
                if at < 0 or base[k][at][1] < e:  # not inside a base span of its kind
                    spans.append((s, i, e, True))
    return [(KINDS[i], s, e, a) for s, i, e, a in sorted(spans)]


def mask(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """``text`` with every span as ``<kind>``; overlapping spans become one, named after the first."""
    out, at = [], 0
    for kind, s, e, _ in spans:
        if s >= at:
            out += (text[at:s], f"<{kind}>")
        at = max(at, e)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, text: str = "text", spans: str = "pii", masked: str | None = None) -> DataFrame:
    """``docs`` with an array of spans ``kind, start, end, added`` and, if asked
    for, the text with its spans masked.

    Offsets count code points, end exclusive. Spans with ``added`` false are
    those of the detectors on the text itself; the added ones appear only in
    its rewritten form and lie in no base span of their kind. Null and empty
    texts have no spans (a null text stays null when masked). Every row is
    judged by itself, whatever its ids; texts are read whole, in linear time.
    ``spans`` and ``masked`` must be names that ``docs`` does not have.
    """
    clash = {c.lower() for c in docs.columns} & {c.lower() for c in (spans, masked) if c}
    if clash:
        raise ValueError(f"docs has columns {sorted(clash)}; name the new ones otherwise")
    new = [T.StructField(spans, T._parse_datatype_string(SPAN))] + ([T.StructField(masked, T.StringType())] if masked else [])
    schema = T.StructType(docs.schema.fields + new)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(text).to_pylist()
            found = [find(t) for t in texts]
            cols = [*batch.columns, pa.array([[dict(zip(("kind", "start", "end", "added"), s)) for s in f] for f in found], kind)]
            if masked:
                cols.append(pa.array([None if t is None else mask(t, f) for t, f in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.mapInArrow(run, schema)


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, doc_id: str = "doc_id", spans: str = "pii") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added``.

    The four counts and the hash are those of the base spans, ``spans`` names
    all, ``n_added`` counts what the method added.
    """
    s = F.col(spans)
    base = F.filter(s, lambda x: ~x["added"])
    count = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col(doc_id).alias("doc_id"), *[count(k) for k in KINDS],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(s).alias("spans"),
                        (F.size(s) - F.size(base)).cast("long").alias("n_added"))


@register("op12_pii")
def op12_pii(spark, sf_dir):
    """Personal data in every document, base and added spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(scan(docs))
