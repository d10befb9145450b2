import random
import re

from statemill.llm import decontaminate as dc


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=13):
    grams = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            n = min(window, len(w))
            for k in range(len(w) - n + 1):
                grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if own := grams.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= own
        out.append((i, len(w), len(hit), sorted(map(str, ids)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, matches int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, n_words string")
    rows = dc.contamination(dc.find_matches(spark, d, b, **kw)).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in rows), key=repr), rows


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["the", "of", "And", "é", "x9", "ten", "one"]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(k, say(rng.randint(14, 40))) for k in range(12)] + [(50, "Lone"), (51, None), (52, "..."), (53, "ten one ten one x9"), (None, "of of"), (54, say(13))]
    items.append((60, items[0][1]))
    docs = [(i, say(rng.randint(0, 200))) for i in range(60)]
    docs += [(100 + k, say(30) + ", " + (t or "") + "! " + say(rng.choice([5, 900]))) for k, (_, t) in enumerate(items)]
    docs += [(200, None), (201, ""), (202, "lone wolf"), (None, items[0][1]), (203, items[1][1]), (203, items[1][1]), (204, " ".join([items[2][1]] * 400))]
    want = brute(docs, items)
    for kw in ({}, {"block_chars": 60}, {"shard_words": 50}):
        assert run(spark, docs, items, **kw)[0] == want


def test_longest_matches_have_places(spark):
    item = " ".join(f"w{k}" for k in range(30))
    doc = "a b " + " ".join(f"W{k}" for k in range(5, 25)) + " c"
    _, rows = run(spark, [(1, doc)], [(9, item)])
    assert [tuple(m) for m in rows[0].matches] == [(9, 2, 5, 20)]


def test_empty_tables_and_removal(spark):
    item = " ".join(f"w{k}" for k in range(15))
    assert run(spark, [], [(1, item)])[0] == []
    assert run(spark, [(1, item)], [])[0] == brute([(1, item)], [])
    d = spark.createDataFrame([(1, item, "k"), (2, "clean text", "k")], "doc_id long, text string, source string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = dc.decontaminate(spark, d, b)
    assert out.columns == ["doc_id", "text", "source"] and [r.doc_id for r in out.collect()] == [2]


def test_repeated_words_give_few_matches(spark):
    items = [(1, "a " * 400), (2, "a " * 30 + "b " * 30)]
    docs = [(1, "a " * 20_000), (2, "b " * 500 + "c " + "a " * 12), (3, "a " * 29 + "b " * 14)]
    got, rows = run(spark, docs, items)
    assert got == brute(docs, items)
    assert all(len(r.matches) <= r.n_words for r in rows) and sum(len(r.matches) for r in rows) < 2500
    own = {i: words(t) for i, t in items}
    for r in rows:
        said = words(dict(docs)[r.doc_id])
        assert all(said[m.doc_at : m.doc_at + m.n_words] == own[m.item_id][m.item_at : m.item_at + m.n_words] for m in r.matches)
