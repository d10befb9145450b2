from statemill.llm import urlfilter as uf


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = path[: min([path.index(c) for c in "?#" if c in path] + [len(path)])]
    fit = [r for r in uf.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


URLS = [None, "", "no scheme/x", "http://", "HTTP://A.B.Example.NET/en/1?x#y", "https://example.net/de/1", "http://notexample.net/en/", "http://EXAMPLE.com/de/4", "http://example.com/de", "x://org/fr/", "x://a.org/fr/2#t", "x://a.org/en/", "x://ÄB.com?x/y", "a\nb://h\nh.com/p\nq?z", "x://y.net?://z", "x://net", "x://net/", "http://spam-farm.example.org/es/7", "http://www.library.example.com/fr/7", "x://" + "a" * 50000 + ".org/" + "b/" * 30000]


def test_rules_and_parts(spark):
    model = uf.train(spark, spark.createDataFrame(uf.labelled_urls(), "url string, label int"))
    df = spark.createDataFrame([(i, u, "mine", 3) for i, u in enumerate(URLS * 2)], "page_id long, url string, verdict string, rule int")
    rows = {r.page_id: r for r in uf.judge(df, model).collect()}
    assert len(rows) == 2 * len(URLS)
    for i, u in enumerate(URLS * 2):
        host, path, rule, verdict = brute(u)
        r = rows[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if model.probability(host, path) >= 0.5 else "allow"))
    assert rows[URLS.index("http://spam-farm.example.org/es/7")].verdict == "block"
    assert rows[URLS.index("http://www.library.example.com/fr/7")].verdict == "allow"
    assert uf.judge(df.limit(0), model).count() == 0


def test_held_out_urls(spark):
    rows = uf.labelled_urls()
    model = uf.train(spark, spark.createDataFrame([r for k, r in enumerate(rows) if k % 4], "url string, label int"))
    held = [(brute(u)[:2], y) for k, (u, y) in enumerate(rows) if not k % 4]
    assert sum((model.probability(*hp) >= 0.5) == bool(y) for hp, y in held) >= 0.97 * len(held)


def test_one_class_or_nothing_blocks_nothing(spark):
    for rows in ([], [("x://a.com/", 1)], [("x://a.com/", None), (None, 1)]):
        model = uf.train(spark, spark.createDataFrame(rows, "url string, label int"))
        assert model.probability("casino.com", "/") < 0.5
