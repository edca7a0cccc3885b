"""Licence scan: the families in their versions, told apart by words and numbers."""

import random

from hotzone.llm import licence_scan as LS

GNU = "This work is licensed under the GNU {}."
CC = "This work is licensed under a Creative Commons {} International License."
CASES = [
    (GNU.format("Lesser General Public License, version 3"), "LGPL-3.0"),
    (GNU.format("Affero General Public License, version 3"), "AGPL-3.0"),
    (GNU.format("General Public License, version 2"), "GPL-2.0"),
    (GNU.format("General Public License, version 3 (GPL v3)"), "GPL-3.0"),
    (GNU.format("General Public License, version 4"), ""),
    (CC.format("Attribution-ShareAlike 4.0"), "CC-BY-SA-4.0"),
    (CC.format("Attribution-NoDerivatives 4.0"), "CC-BY-ND-4.0"),
    (CC.format("Attribution-NonCommercial-ShareAlike 4.0"), "CC-BY-NC-SA-4.0"),
    ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "CC-BY-3.0"),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("Released under CC0 1.0.", "CC0-1.0"), ("Licensed under the Eclipse Public License, version 2.0.", "EPL-2.0"),
    ("Licensed under the 3-Clause BSD License.", "BSD-3-Clause"), ("Licensed under the Apache License, Version 1.1.", "Apache-1.1"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
     "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1"),
    (LS.TEMPLATES["BSD-2-Clause"][0], "BSD-2-Clause"), (LS.ALL["BSD-3-Clause"][-1], "BSD-3-Clause"),
]



def test_families_and_versions(spark):
    rnd = random.Random(5)
    words = "the of licensed under public software free general version 3 work and permission text".split()
    rows = [t for t, _ in CASES] + [t for ts in LS.ALL.values() for t in ts]
    for _ in range(300):  # altered notices: the words to look for first must lose none
        w = rnd.choice(rnd.choice(list(LS.ALL.values()))).split()
        for _ in range(rnd.randrange(1, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in LS.scan_licences(df).collect()}
    assert [(t, got[i].licences) for i, (t, _) in enumerate(CASES)] == CASES
    at = len(CASES)
    for name, texts in LS.ALL.items():
        for t in texts:
            assert (got[at].licence, got[at].licences, got[at].dice) == (name, name, 1.0), t
            at += 1
    spec = LS._templates(LS.ALL, 0.8)
    for i in range(at, len(rows)):
        tok, g = LS._tokens_py(rows[i]), set(LS._bigrams_py(rows[i]))
        want = {n for n, _, _, t, need, ban in spec if 2 * len(g & set(t)) >= (0.8 - 1e-12) * (len(g) + len(t))
                and tok.issuperset(need) and tok.isdisjoint(ban)}
        assert got[i].licences == ",".join(sorted(want)), rows[i]
