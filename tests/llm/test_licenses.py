import re

import pytest

from statemill.llm import licenses as lc


def brute(text, threshold=0.8):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    units = [*low.split("\n"), *re.split(r"\n[\t\r ]*\n", low), low]
    best = {}
    for u in units:
        g = set(lc.bigrams_of(re.findall(lc.WORD, u)))
        for name, t in lc.TEMPLATES:
            m = set(lc.bigrams_of(lc.words_of(t)))
            if g:
                best[name] = max(best.get(name, 0), 2 * len(g & m) / (len(g) + len(m)))
    return sorted((n, round(d, 9)) for n, d in best.items() if d >= threshold)


MIT = lc.TEMPLATES[3][1]
TEXTS = [
    None, "", "word", "two words", "Released under the MIT License.", "text before\n  RELEASED under the MIT license\ntext after", "Released under the MIT License. " * 40,
    MIT, MIT.replace(" ", "\n"), "intro line\n\n" + MIT.replace("any person", "anyone at all").replace(", ", ",\n") + "\n \t\nend", MIT.replace("Software", "Program"), "x y " * 30000 + "\nAll rights reserved.",
    "Licensed under CC BY-NC 4.0", "Licensed under CC BY 4.0", "All rights reserved. Copyright 2020", "Licensed under the Apache License, Version 2.0. and more words that follow", "licence sous MIT é All RIGHTS reserved",
]


def test_against_all_comparisons(spark):
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, licenses int")
    out = lc.scan(df)
    assert out.columns == ["doc_id", "text", "licenses"]
    rows = {r.doc_id: sorted((x.license, round(x.dice, 9)) for x in r.licenses) for r in out.collect()}
    assert rows == {i: brute(t) for i, t in enumerate(TEXTS * 2)}
    assert rows[4] == [("MIT", 1.0)] and rows[7] == [("MIT", 1.0)] and rows[0] == []
    assert lc.scan(df.limit(0)).count() == 0


def test_pruning_rules_lose_nothing():
    for t in (0.5, 0.8, 1.0):
        for p in lc.prepare(lc.TEMPLATES, t):
            m = len(p.bigrams)
            for u in range(1, 3 * m):
                assert (2 * min(u, m) / (u + m) >= t - 1e-12) <= (p.least <= u <= p.most)
            assert sum(not p.anchors & set(g.split(" ")) for g in p.bigrams) < p.least


def test_templates_need_a_bigram():
    with pytest.raises(ValueError):
        lc.prepare([("x", "one")], 0.8)


def brute_windows(text, threshold=0.8):
    """Every window of every length within the bounds, nothing left out."""
    best = dict(brute(text, 0))
    words = lc.words_of(text or "")
    for t in lc.prepare(lc.TEMPLATES, threshold):
        mine = set(t.bigrams)
        for u in range(t.least, t.most + 1):
            for i in range(len(words) - u):
                g = set(lc.bigrams_of(words[i : i + u + 1]))
                best[t.name] = max(best.get(t.name, 0), round(2 * len(g & mine) / (len(g) + len(mine)), 9))
    return sorted((n, d) for n, d in best.items() if d >= threshold)


GPL = lc.TEMPLATES[5][1]
INSIDE = [
    ("Copyright (c) 2021 Example Inc. All rights reserved.", "all-rights-reserved"),
    ("This package is released under the MIT License. See LICENSE for details.", "MIT"),
    ("/*\n * " + MIT.replace(", ", ",\n * ") + "\n *\n * The above copyright notice shall be included in all copies.\n */\nint main() { return 0; }" + "".join(f"\nint f{k}(int a{k}) {{ return b{k}; }}" for k in range(9)), "MIT"),
    ("# Tool for lists\n#\n# " + GPL.replace(" it ", " it\n# ").replace(" as ", "\n# as ").replace(", ", ",\n# ") + "\n#\n# It comes without any warranty; see the text for more.\nimport os" + "".join(f"\ndef f{k}(a{k}): return b{k}" for k in range(30)), "GPL-3.0"),
    (" ".join(f"w{k}" for k in range(90)) + " " + GPL.replace("either", "under either one").replace("modify", "change") + "".join(f" v{k}" for k in range(90)), "GPL-3.0"),
]


def test_notices_inside_longer_units(spark):
    texts = [t for t, _ in INSIDE] + [t for t in TEXTS if t is None or len(t) < 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = lc.scan(df, windows=True)
    assert out.columns == ["doc_id", "text", "licenses"]
    rows = {r.doc_id: sorted((x.license, round(x.dice, 9)) for x in r.licenses) for r in out.collect()}
    assert rows == {i: brute_windows(t) for i, t in enumerate(texts)}
    for i, (_, name) in enumerate(INSIDE):
        assert name in dict(rows[i])
        assert name not in dict(brute(texts[i]))
