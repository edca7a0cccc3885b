"""Operator 9: licence scan (DataFrame functions only).

Blocks of a document (its lines, and its paragraphs of several lines) are
normalised to words and compared to licence templates by the Dice coefficient
over their sets of word bigrams. A template is compared only if its size lies
within the bounds that the threshold leaves for the block's size, and licences
whose texts are close are told apart by the words and numbers that differ.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotzone.llm.common import ascii_lower, free_name, register, table

# fixed values: the wording of licence notices and grants; the oracle states these
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

FRAMES = ("Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This project is licensed under {}.")


def _families() -> dict[str, list[str]]:
    """Notices of the usual families in every version, by licence."""
    out: dict[str, list[str]] = {}

    def add(name: str, *phrases: str, frames=FRAMES, notices=()) -> None:
        out.setdefault(name, []).extend([f.format(p) for p in phrases for f in frames] + list(notices))

    for short, title, versions in (("GPL", "General", ("1.0", "2.0", "3.0")), ("LGPL", "Lesser General", ("2.1", "3.0")),
                                   ("LGPL", "Library General", ("2.0",)), ("AGPL", "Affero General", ("3.0",))):
        for v in versions:
            n, full = v.removesuffix(".0"), f"GNU {title} Public License"
            add(f"{short}-{v}", f"the {full}, version {n}", f"the {full} v{v}", f"the GNU {short} version {n}", f"{short}-{v}", f"{short}v{n}",
                notices=[f"This program is free software: you can redistribute it and/or modify it under the terms of the {full} "
                         f"{rest}" for rest in (
                             f"as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version.",
                             f"as published by the Free Software Foundation, version {n} of the License.",
                             f"version {n} as published by the Free Software Foundation.")])
    parts = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
    for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
        for v, port in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
            title = "-".join(parts[k] if k != "ND" or v == "4.0" else "NoDerivs" for k in kind.split("-"))
            add(f"CC-{kind}-{v}", f"CC {kind} {v}", f"a Creative Commons {title} {v} License", f"a Creative Commons {title} {v} {port} License")
    add("CC0-1.0", "CC0 1.0", "CC0", "CC0 1.0 Universal", "the Creative Commons CC0 1.0 Universal Public Domain Dedication",
        notices=["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this "
                 "software to the public domain worldwide. This software is distributed without any warranty.",
                 "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."])
    for v in ("1.0", "1.1", "2.0"):
        add(f"Apache-{v}", f"the Apache License, Version {v}", f"the Apache License {v}", f"Apache-{v}", f"the Apache {v} License")
    add("MIT", "the MIT License", "MIT", "MIT License")
    add("ISC", "the ISC License")
    for k, names in ((2, ("Simplified",)), (3, ("New", "Modified", "Revised"))):
        add(f"BSD-{k}-Clause", f"the BSD {k}-Clause License", f"the {k}-Clause BSD License", f"BSD-{k}-Clause",
            *[f"the {x} BSD License" for x in names])
    add("BSD-4-Clause", "the BSD 4-Clause License", "the 4-Clause BSD License")
    grant = TEMPLATES["BSD-2-Clause"][0]
    copied = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products " \
             "derived from this software without specific prior written permission."
    advert = "All advertising materials mentioning features or use of this software must display the following acknowledgement: " \
             "This product includes software developed by the copyright holder."
    add("BSD-3-Clause", notices=[f"{grant} {copied}"])
    add("BSD-4-Clause", notices=[f"{grant} {advert} {copied}"])
    for v in ("1.0", "1.1", "2.0"):
        add(f"MPL-{v}", f"the Mozilla Public License, version {v}", f"the Mozilla Public License {v}", f"MPL-{v}")
    for v in ("1.0", "1.1"):
        add(f"MPL-{v}", notices=[
            f"The contents of this file are subject to the Mozilla Public License Version {v} (the \"License\"); you may not use this file "
            "except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"])
    for v in ("1.0", "2.0"):
        add(f"EPL-{v}", f"the Eclipse Public License, version {v}", f"the Eclipse Public License {v}", f"the Eclipse Public License v{v}", f"EPL-{v}",
            notices=["This program and the accompanying materials are made available under the terms of the Eclipse Public License "
                     f"{x}" for x in (f"v{v} which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v{v.replace('.', '')}.html",
                                      f"{v} which is available at https://www.eclipse.org/legal/epl-{v}")])
    add("BSL-1.0", "the Boost Software License, Version 1.0", notices=["Distributed under the Boost Software License, Version 1.0."])
    add("Unlicense", "the Unlicense")
    return out


FAMILIES = _families()
#: All templates: the notices above and the families, each wording once.
ALL: dict[str, list[str]] = {k: list(dict.fromkeys(TEMPLATES.get(k, []) + FAMILIES.get(k, []))) for k in sorted({*TEMPLATES, *FAMILIES})}

# fixed values: words, pairs of words and numbers that tell one licence from another
MARKS = frozenset(
    "1 2 3 4 5 v1 v2 v3 gnu gpl lgpl agpl gplv1 gplv2 gplv3 lgplv2 lgplv3 agplv3 lesser affero nc sa nd noncommercial sharealike "
    "noderivatives noderivs by cc cc0 apache mit isc bsd simplified new modified revised neither endorse advertising mozilla mpl "
    "eclipse epl boost unlicense".split()) | {"library general", "1 0", "1 1"}
WEAK = frozenset("by new simplified modified revised".split())  # a block may have them anyway
# fixed values: words that are common in any text, for the choice of words to look for first
COMMON = frozenset(
    "a all and any are as at author be by can following for free from had has have in is it its law made may must name names new not of "
    "on one only or other program project public released rights that the their this to under use used which with without work "
    "worldwide you your 0 1 2 3 4 5".split())

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _bigrams_py(text: str) -> list[str]:
    w = [x for x in re.split(NOT_WORD, text.lower()) if x]
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def _tokens_py(text: str) -> set[str]:
    return {x for g in _bigrams_py(text) for x in (g, *g.split(" "))}


def _templates(templates: dict[str, list[str]], threshold: float) -> list[tuple[str, int, int, list[str], list[str], list[str]]]:
    """(licence, smallest and largest size of a block that can pass, bigrams,
    marks that a block must have, marks that it must not have).

    The marks are those in which a template differs from the close ones of
    other licences, and that no template of its own licence has. Two that can both pass for one block have a Dice of at
    least (3 t - 2) / t: the block holds both, and they may overlap by no more.
    """
    spec = [(name, text, set(_bigrams_py(text)), _tokens_py(text) & MARKS) for name in sorted(templates) for text in templates[name]]
    own = {name: set().union(*(m for n, _, _, m in spec if n == name)) for name in templates}
    close = (3 * threshold - 2) / threshold - 1e-9
    out = []
    for name, text, g, m in spec:
        need: set[str] = set()
        ban: set[str] = set()
        for other, _, h, n in spec:
            if other != name and m != n and 2 * len(g & h) >= close * (len(g) + len(h)):
                need |= m - n
                ban |= n - own[name] - WEAK
        out.append((name, math.ceil(len(g) * threshold / (2 - threshold) - 1e-9),
                    math.floor(len(g) * (2 - threshold) / threshold + 1e-9), sorted(g), sorted(need), sorted(ban)))
    return out


def _first(spec: list, threshold: float, size: int) -> list[str]:
    """Words (size 1) or bigrams (size 2) of which every block that can pass has
    at least one.

    A block with none of them lacks the k bigrams of a template that hold one,
    so its Dice is at most 2 (n - k) / (2 n - k) of the n; the uncommon and
    long are taken first, until that is below the threshold.
    """
    chosen: set[str] = set()
    for _, _, _, g, _, _ in spec:
        units = [set(x.split(" ")) if size == 1 else {x} for x in g]
        for u in sorted(set().union(*units), key=lambda u: (u not in chosen, sum(w in COMMON for w in u.split(" ")), -len(u), u)):
            k = sum(bool(x & chosen) for x in units)
            if 2 * (len(g) - k) < (threshold - 1e-9) * (2 * len(g) - k):
                break
            chosen.add(u)
    return sorted(chosen)


def _sql(x) -> str:
    """A constant as SQL text, a list inside a list as a struct or an array of strings."""
    if isinstance(x, str):
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(x, int):
        return str(x)
    kind = "struct" if any(isinstance(y, int) for y in x) else "array"
    return f"{kind}({', '.join(map(_sql, x))})"


def scan_licences(docs: DataFrame, templates: dict[str, list[str]] = ALL, threshold: float = 0.8,
                  text: str = "text") -> DataFrame:
    """``docs`` plus ``n_blocks``, ``n_matched`` (blocks with a licence),
    ``licence`` (the best one, null if none), ``dice`` (its coefficient, 0 if
    none) and ``licences`` (all, sorted, comma-joined).

    A line of a one-line paragraph is one block. Ties go to the first licence
    by name. A block that names a licence must agree with the template in the
    words and numbers that its close ones differ in (``MARKS``). Null, empty and one-word blocks match nothing. Columns of docs
    with such names are replaced; others pass through. One map-only stage:
    the templates are constants of the plan.
    """
    spec = _templates(templates, threshold)
    bl, gr, hi = free_name(docs, "blocks", "grams", "hits")
    lo = min((s[1] for s in spec), default=1)
    known = F.expr(f"cast({_sql([list(x) for x in spec])} as array<struct<licence:string,least:int,most:int,"
                   "grams:array<string>,need:array<string>,ban:array<string>>>)")
    first, pairs = (F.expr(f"cast({_sql(_first(spec, threshold, n))} as array<string>)") for n in (1, 2))
    body = F.coalesce(F.col(text), F.lit(""))
    paras = F.filter(F.split(body, r"\n[ \t\r]*\n"), lambda p: F.contains(F.btrim(p, F.lit("\n")), F.lit("\n")))
    blocks = F.filter(F.concat(F.split(body, "\n"), paras), lambda b: F.length(F.trim(b)) > 0)

    def words(b: Column) -> Column:
        return F.array_remove(F.split(ascii_lower(b), NOT_WORD), "")

    def bigrams(w: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 1),
                                            lambda i: F.concat(F.get(w, i - 1), F.lit(" "), F.get(w, i))))

    cand = F.filter(F.transform(bl, words), lambda w: (F.size(w) > max(lo, 1)) & F.arrays_overlap(w, first))

    def best(z: Column) -> Column:
        g, t = z["grams"], F.concat(z["words"], z["grams"])
        may = F.filter(known, lambda k: F.size(g).between(k["least"], k["most"]) & ~F.arrays_overlap(t, k["ban"])
                       & (F.size(F.array_except(k["need"], t)) == 0))
        dice = F.transform(may, lambda k: F.struct(
            (2.0 * F.size(F.array_intersect(g, k["grams"])) / (F.size(g) + F.size(k["grams"]))).alias("dice"), k["licence"].alias("licence")))
        return F.filter(dice, lambda d: d["dice"] >= threshold - 1e-12)

    keep = [c for c in docs.columns if c not in ("n_blocks", "n_matched", "licence", "dice", "licences")]
    out = docs.select(*keep, blocks.alias(bl))
    grams = F.transform(cand, lambda w: F.struct(w.alias("words"), bigrams(w).alias("grams")))
    grams = F.filter(grams, lambda z: F.arrays_overlap(z["grams"], pairs))
    out = out.select(*keep, F.size(bl).cast("long").alias("n_blocks"), grams.alias(gr))
    out = out.select(*keep, "n_blocks", F.filter(F.transform(gr, best), lambda h: F.size(h) > 0).alias(hi))
    flat = F.flatten(hi)
    top = F.array_max(F.transform(flat, lambda z: z["dice"]))
    return out.select(
        *keep, "n_blocks", F.size(hi).cast("long").alias("n_matched"),
        F.array_min(F.transform(F.filter(flat, lambda z: z["dice"] == top), lambda z: z["licence"])).alias("licence"),
        F.coalesce(top, F.lit(0.0)).alias("dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(flat, lambda z: z["licence"]))), ",").alias("licences"))


def _oracle(threshold: float = 0.8) -> str:
    values = []
    for name in sorted(TEMPLATES):
        for text in TEMPLATES[name]:
            values.append("('" + name + "', '" + text.replace("'", "''") + "')")
    split = r"list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return rf"""
WITH t AS (SELECT licence, {grams} AS g FROM (SELECT licence, {split.format('body')} AS w FROM (VALUES {', '.join(values)}) AS v(licence, body))),
d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
b AS (SELECT doc_id, unnest(list_filter(string_split(body, chr(10)) || list_filter(regexp_split_to_array(body, '\n[ \t\r]*\n'),
  lambda p: contains(trim(p, chr(10)), chr(10))), lambda x: length(trim(x, ' ')) > 0)) AS block FROM d),
bg AS (SELECT doc_id, row_number() OVER () AS bid, {grams} AS g FROM (SELECT doc_id, {split.format('block')} AS w FROM b)),
m AS (SELECT doc_id, bid, licence, 2.0 * len(list_intersect(bg.g, t.g)) / (len(bg.g) + len(t.g)) AS dice
  FROM bg JOIN t ON len(bg.g) BETWEEN len(t.g) * {threshold} / (2 - {threshold}) - 1e-9 AND len(t.g) * (2 - {threshold}) / {threshold} + 1e-9),
h AS (SELECT * FROM m WHERE dice >= {threshold} - 1e-12),
s AS (SELECT doc_id, count(DISTINCT bid) AS n_matched, first(licence ORDER BY dice DESC, licence) AS licence, max(dice) AS dice,
  string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM h GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_blocks FROM b GROUP BY doc_id)
SELECT doc_id, coalesce(n_blocks, 0) AS n_blocks, coalesce(n_matched, 0) AS n_matched, licence,
  round(CAST(coalesce(dice, 0) AS DOUBLE), 9) AS dice, coalesce(licences, '') AS licences
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""


@register("op9_licence_scan", sql=_oracle())
def op9_licence_scan(spark, sf_dir):
    """Licences named or granted in each document."""
    out = scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.drop("text").withColumn("dice", F.round("dice", 9))
