"""Operator 8: main text of web pages by nearest-URL page differencing.

A page is cut into blocks of text. Blocks inside the page's own boilerplate
elements go. Every page is paired with its neighbours by URL path on the same
host, and their lines (those inside a marked main region, article or main, where
a page has one) are aligned by longest common subsequence. Shared lines go: in
pages without a main region all of them, in a main region those that an exact
check confirms, so that passages which two articles have in common stay.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hotzone.llm.common import free_name, register, ship, table, written

ship(__name__)

OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
ATTR = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|(?![\"'])([^\s>]*+)))?")
GAP = re.compile(r"[\s/]*+")
READ = frozenset("class id role style hidden".split())
# fixed values: element names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select "
    "summary table tbody td tfoot th thead tr ul".split())
SKIP = frozenset(
    "head nav footer aside form menu dialog button select noscript template svg math canvas object audio video map datalist "
    "fieldset".split())
MAIN = frozenset(("article", "main"))
NESTS = frozenset("html body div section header table ul ol blockquote figure".split())
ENDED = {"p": BLOCK, "li": frozenset(("li",)), "dd": frozenset(("dd", "dt")), "dt": frozenset(("dd", "dt")),
         "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr"))}
# fixed values: words in a class, id or role that mark boilerplate
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe signup sidebar widget menu nav navbar navigation breadcrumb "
    "breadcrumbs masthead topbar header footer comment comments disqus reply replies respond social share sharing related "
    "recommended toolbar pagination pager login search complementary contentinfo dialog alert".split())
HINT_WORD = re.compile(r"[a-z]+")
# fixed values: whole class tokens that mark boilerplate in a main region, where the others name parts of the text
MAIN_HINTS = HINTS - frozenset("header alert search promotion advertising".split())
ROLES = frozenset("banner navigation search complementary contentinfo dialog alertdialog alert menu menubar toolbar".split())
# fixed values: whole ids that mark boilerplate in a main region
MAIN_IDS = frozenset("ad ads advert comments disqus newsletter sidebar footer signup navbar breadcrumb breadcrumbs".split())
# fixed values: a compound name is boilerplate if all its words are of these two lists, one at least of the first
LEADS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo cookie cookies consent gdpr popup newsletter subscribe signup "
    "sidebar nav navbar breadcrumb breadcrumbs comment comments disqus replies respond social share sharing related recommended "
    "pagination footer login search".split())
PLACES = frozenset(
    "area article articles banner bar block body bottom box button buttons container content count entry form group header "
    "icons inline inner item items left link links list main menu modal more notice overlay page panel placeholder post posts "
    "reader readers right row section site slot stories story thread title toggle tools top unit up user users widget wrap "
    "wrapper".split())
NAMED = frozenset("div section aside ol ul dl table iframe".split())  # whose ids name a region, not a heading
PROSE = frozenset("p h1 h2 h3 h4 h5 h6".split())
# fixed values: in a main region these name parts that the articles of a site have in common
LABELS = frozenset("h1 h2 h3 h4 h5 h6 hgroup li dt dd td th tr caption figcaption pre summary address".split())
OFTEN, SITE = 0.5, 4  # a line of the site: on this share of a host's pages, and on so many
LABEL, PLAIN, DOUBTFUL = 0, 1, 2
PROSE_HINTS = MAIN_HINTS - frozenset("notice notices".split())


def _compound(token: str) -> bool:
    parts = [p for p in re.split(r"[-_]+", token) if p]
    return len(parts) > 1 and not LEADS.isdisjoint(parts) and all(p in LEADS or p in PLACES for p in parts)


def _hinted(name: str, attrs: list[tuple[str, str]], main: bool) -> bool:
    """Whether an element's attributes mark it as boilerplate.

    Ids are often slugs of headings, so they count only on regions, and only
    as whole names (not on sections, which documents name by their headings) or
    as compounds of known words. On headings and paragraphs no id, no compound
    and no "notice" counts. Outside a main region any word of a class or
    role counts, but on headings and paragraphs.
    """
    for key, value in attrs:
        value = value.lower()
        if key == "hidden" or key == "style" and "display:none" in "".join(value.split()):
            return True
        tokens = value.split()
        if key == "role" and not ROLES.isdisjoint(tokens):
            return True
        if key == "class":
            if name in PROSE:
                if not PROSE_HINTS.isdisjoint(tokens):
                    return True
            elif main:
                if not MAIN_HINTS.isdisjoint(tokens) or any(map(_compound, tokens)):
                    return True
            elif not HINTS.isdisjoint(HINT_WORD.findall(value)):
                return True
        elif key == "id" and name in NAMED:
            whole = frozenset() if name == "section" else MAIN_IDS if main else HINTS
            if any(t in whole or _compound(t) for t in tokens):
                return True
    return False


def _doubtful(name: str, attrs: list[tuple[str, str]]) -> bool:
    """Whether a class in a main region holds a word of boilerplate that does not suffice by itself."""
    return name not in LABELS and any(
        k == "class" and not (HINTS - {"header"}).isdisjoint(HINT_WORD.findall(v.lower())) for k, v in attrs)


def _attributes(page: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """The attributes that are looked at, and the place behind the tag whose
    name ends at ``at``: 0 if the page ends within it. A quote without an end
    is part of a name, so every character is read once."""
    out = []
    while m := ATTR.match(page, at):
        at = m.end()
        key = m[1].lower()
        if key in READ:
            out.append((key, m[2] or m[3] or m[4] or ""))
    at = GAP.match(page, at).end()
    return out, at + 1 if at < len(page) else 0


def blocks_of(page: str | None) -> list[tuple[bool, str]]:
    """(inside a main region, text) of the page's blocks outside boilerplate elements, in order."""
    return [(m, t) for m, t, _ in _blocks(page)]


def _blocks(page: str | None) -> list[tuple[bool, str, int]]:
    """:func:`blocks_of` with each block's kind (``LABEL``, ``PLAIN``, ``DOUBTFUL``).

    Linear in the page. A tag or comment that the page's end cuts off ends it.
    """
    out: list[tuple[bool, str, int]] = []
    if not page:
        return out
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, skipped, main, doubtful
    scopes: list[Counter] = [Counter()]  # names open in each main region, the innermost last
    inside = False  # whether the block begun in ``parts`` is in a main region
    kind = PLAIN  # by the last element begun since the last block

    def end_block() -> None:
        nonlocal kind
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((inside, text, DOUBTFUL if stack and stack[-1][3] else kind))
        kind = PLAIN

    def pop() -> tuple[str, bool, bool, bool]:
        top = stack.pop()
        scopes[-1][top[0]] -= 1
        if top[0] in MAIN:
            scopes.pop()
        return top

    at, n = 0, len(page)
    while at < n:
        m = OPEN.search(page, at)
        stop = m.start() if m else n
        off = bool(stack) and stack[-1][1]
        if stop > at and not off:
            if not parts:
                inside = bool(stack) and stack[-1][2]
            parts.append(page[at:stop])
        if not m:
            break
        if m[5] is None:  # comment, character data or declaration
            end = "-->" if m[1] else "]]>" if m[2] else ">"
            at = page.find(end, m.end())
            if at < 0:
                break
            at += len(end)
            continue
        name, attrs, at = m[5].lower(), *_attributes(page, m.end())
        if not at:
            break
        if m[4]:
            if name in BLOCK and not off:
                end_block()
            # a stray end tag does not close the main region
            if scopes[-1][name] or name in ("body", "html") and any(s[0] == name for s in stack):
                while pop()[0] != name:
                    pass
                if name in BLOCK and not (stack and stack[-1][1]):
                    end_block()
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if name in BLOCK:
            while stack and name in ENDED.get(stack[-1][0], ()):
                off = pop()[1] and bool(stack) and stack[-1][1]
            if not off:
                end_block()
        elif name in VOID and not off:
            parts.append(" ")
        if name in VOID or page[at - 2] == "/" and name not in BLOCK:
            continue
        skipped, main, unsure = stack[-1][1:] if stack else (False, False, False)
        if not skipped:
            if name in SKIP or name == "header" and not main:
                skipped = True
            elif name in MAIN:
                skipped = main and name == "article" and _hinted(name, attrs, main)  # reader comments are articles in an article
                main = True
            elif name not in ("html", "body") and attrs:
                skipped = _hinted(name, attrs, main)
                main = main or not skipped and any(k == "role" and "main" in v.lower().split() for k, v in attrs)
            if main and name in BLOCK:
                doubt = name not in MAIN and _doubtful(name, attrs)
                unsure = unsure or doubt and name in NESTS
                kind = LABEL if name in LABELS else DOUBTFUL if doubt and name not in NESTS else PLAIN
        outer = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if skipped or main != outer[1] or name in MAIN or name in NESTS:
            stack.append((name, skipped, main, unsure))
            if name in MAIN:
                scopes.append(Counter())
            scopes[-1][name] += 1
    end_block()
    return out


def main_lines(page: str | None) -> tuple[bool, list[str]]:
    """Whether the page marks a main region, and its lines (that region's, else all)."""
    return main_blocks(page)[:2]


def main_blocks(page: str | None) -> tuple[bool, list[str], list[int]]:
    """:func:`main_lines` with the lines' kinds."""
    blocks = _blocks(page)
    marked = any(b[0] for b in blocks)
    kept = [b for b in blocks if b[0] or not marked]
    return marked, [b[1] for b in kept], [b[2] for b in kept]


def shared_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which lines of ``a`` lie on its longest common subsequence with ``b``.

    Hunt-Szymanski: matches are taken as increasing positions in ``b``, so the
    cost follows the number of equal line pairs, not the product of lengths.
    """
    at: dict[int, list[int]] = {}
    for j, h in enumerate(b.tolist()):
        at.setdefault(h, []).append(j)
    ends: list[int] = []
    tails: list[tuple] = []
    for i, h in enumerate(a.tolist()):
        for j in reversed(at.get(h, ())):
            k = bisect_left(ends, j)
            node = (i, tails[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                tails.append(node)
            else:
                ends[k], tails[k] = j, node
    out = np.zeros(len(a), bool)
    node = tails[-1] if tails else None
    while node:
        out[node[0]] = True
        node = node[1]
    return out


def _parsed(pages: DataFrame, html: str, keep: list[str], marked: str, lines: str, kinds: str) -> DataFrame:
    schema = T.StructType([pages.schema[c] for c in keep] + [
        T.StructField(marked, T.BooleanType()), T.StructField(lines, T.ArrayType(T.StringType())),
        T.StructField(kinds, T.ArrayType(T.ByteType()))])

    def run(batches):
        for batch in batches:
            got = [main_blocks(x.as_py()) for x in batch.column(html)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array([g[0] for g in got], pa.bool_()),
                 pa.array([g[1] for g in got], pa.list_(pa.string())), pa.array([g[2] for g in got], pa.list_(pa.int8()))], names=schema.names)

    return pages.mapInArrow(run, schema)


def neighbour_shared(lines: DataFrame) -> DataFrame:
    """``row, drop``: the lines that a page shares with the page before or after it.

    lines: ``row, marked, host, path, hashes``; pages that mark a main region are
    paired with such pages, others with others. Pages of a host with the same lines are
    copies: they count as one page, at the first of their paths, and lose the
    same lines. Those pages are put in one global order of (host, path, row) by
    range partitions that are written once and numbered by partition, so a hot
    host lies on many tasks and the order does not depend on where the
    partitions were cut. Where one page's lines all lie in the other, it is a
    shortened copy of it or has no text of its own; such a pair tells nothing
    and deletes nothing. In a main region that holds from half of the lines on:
    such pages are versions of one article.
    """
    lines = lines.withColumn("same", F.xxhash64("hashes"))
    site = ["marked", "host"]
    first = lines.groupBy(*site, "same").agg(F.min(F.struct("path", "row", "hashes")).alias("p")).select(*site, "same", "p.*")
    ranged = written(first.repartitionByRange(*site, "path", "row").withColumn("part", F.spark_partition_id()), "ranged")
    per = ranged.groupBy("part").count()  # one row per partition
    before = per.withColumn("base", F.coalesce(F.sum("count").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")
    number = F.row_number().over(Window.partitionBy("part").orderBy(*site, "path", "row"))
    ordered = ranged.select("part", *site, "row", "hashes", number.alias("k")).join(F.broadcast(before), "part")
    ordered = written(ordered.select((F.col("base") + F.col("k")).alias("n"), *site, "row", "hashes"), "ordered")
    nxt = ordered.select((F.col("n") - 1).alias("n"), F.col("marked").alias("marked2"), F.col("host").alias("host2"), F.col("row").alias("row2"), F.col("hashes").alias("hashes2"))
    pairs = ordered.join(nxt, "n").filter("marked = marked2 AND host = host2").select("marked", "row", "hashes", "row2", "hashes2")

    def run(batches):
        for batch in batches:
            rows, drop = [], []
            for i in range(batch.num_rows):
                a, b = (np.array(batch.column(c)[i].as_py(), np.int64) for c in ("hashes", "hashes2"))
                hits = np.flatnonzero(shared_lines(a, b)), np.flatnonzero(shared_lines(b, a))
                least = min(len(a), len(b))
                if len(hits[0]) == least or batch.column("marked")[i].as_py() and 2 * len(hits[0]) > least:
                    continue
                for r, hit in zip(("row", "row2"), hits):
                    if len(hit):
                        rows.append(batch.column(r)[i].as_py())
                        drop.append(hit.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(drop, pa.list_(pa.int64()))], names=["row", "drop"])

    found = pairs.mapInArrow(run, "row long, drop array<long>")
    found = found.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("drop"))).alias("drop"))  # two pairs a row
    of_class = first.select(*site, "same", "row").join(found, "row").select(*site, "same", "drop")
    return lines.select("row", *site, "same").join(of_class, [*site, "same"]).select("row", "drop")


def confirmed(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """``row, drop``: the ``shared`` lines of main regions that are boilerplate.

    lines: ``row, host, path, hashes, kinds`` of pages that mark a main region.
    A shared line goes if a class marks it as doubtful, or if it is no label
    (heading, item, cell) and half of the host's pages hold it, copies counted
    once, four at least. Lines travel as hashes.
    """
    site = F.xxhash64("host").alias("site")
    found = written(lines.join(shared, "row").select("row", site, F.explode("drop").alias("at"), "hashes", "kinds").select(
        "row", "site", "at", F.get("hashes", F.col("at").cast("int")).alias("line"), F.get("kinds", F.col("at").cast("int")).alias("kind"))
        .filter(f"kind <> {LABEL}"), "found")
    pages = lines.groupBy(site, F.xxhash64("hashes").alias("same")).agg(F.first("hashes").alias("hashes"))
    of_site = pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    asked = found.filter(f"kind = {PLAIN}").select("site", "line").distinct()
    often = (pages.select("site", F.explode(F.array_distinct("hashes")).alias("line")).join(asked, ["site", "line"], "left_semi")
             .groupBy("site", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SITE)
             .join(of_site, "site").filter(F.col("n") >= OFTEN * F.col("pages")).select("site", "line"))
    gone = found.filter(f"kind = {DOUBTFUL}").select("row", "at").unionByName(
        found.filter(f"kind = {PLAIN}").join(often, ["site", "line"], "left_semi").select("row", "at"))
    return gone.groupBy("row").agg(F.collect_list("at").alias("drop"))


def extract_text(pages: DataFrame, html: str = "html", url: str = "url", out_text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``pages`` without ``html``, plus its main text (blocks joined by line
    feeds, '' if none) and the text's code points.

    Character references are decoded and white space in a block becomes one
    space. A null or empty page has no text; a null url counts as no host, and
    such pages are not paired. Repeated rows get the same text; copies on a host
    count as one page when neighbours are compared. Columns of pages with the new names are
    replaced; others pass through. Truncated pages end where they end.
    """
    keep = [c for c in pages.columns if c not in (html, out_text, n_chars)]
    marked, lines, kinds, row, drop = free_name(pages, "marked", "lines", "kinds", "row", "drop")
    base = pages.select(*dict.fromkeys([*keep, html, url]))
    got = _parsed(base, html, list(dict.fromkeys([*keep, url])), marked, lines, kinds)
    got = written(got.withColumn(row, F.monotonically_increasing_id()), "blocks")
    bare = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", "")
    hashed = written(got.filter((F.size(lines) > 0) & F.col(url).isNotNull()).select(
        F.col(row).alias("row"), F.col(marked).alias("marked"), F.lower(F.substring_index(bare, "/", 1)).alias("host"),
        F.regexp_replace(bare, "^[^/]*", "").alias("path"), F.transform(lines, lambda x: F.xxhash64(x)).alias("hashes"),
        F.col(kinds).alias("kinds")), "hashed")
    shared = written(neighbour_shared(hashed.drop("kinds")), "shared")
    regions = written(confirmed(hashed.filter("marked"), shared), "regions")
    left = F.when(F.col(drop).isNull(), F.col(lines)).otherwise(
        F.filter(lines, lambda x, i: ~F.array_contains(F.col(drop), i.cast("long"))))

    def without(part: DataFrame, found: DataFrame) -> DataFrame:
        return part.join(found.select(F.col("row").alias(row), F.col("drop").alias(drop)), row, "left").select(
            *keep, F.array_join(left, "\n").alias(out_text))

    # few lines of main regions go: their texts meet no shuffle while the table of those lines is small
    done, rest = without(got.filter(marked), regions), without(got.filter(~F.col(marked)), shared)
    return done.unionByName(rest).withColumn(n_chars, F.length(out_text).cast("long"))


@register("op8_html_extract")
def op8_html_extract(spark, sf_dir):
    """The main text of every page."""
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
