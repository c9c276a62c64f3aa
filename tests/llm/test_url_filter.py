"""Address rules against plain Python, the model against held-out addresses."""

from __future__ import annotations

from tonelake.llm import queries, url_filter

SCHEMA = "name long, url string, host string, rule string"

URLS = [
    None, "", "no scheme/here", "http://net", "http://net/", "HTTP://A.NET/x?y#z", "ftp://example.net/en", "x://EXAMPLE.net/en/a",
    "https://a.example.net/en/b?c", "https://notexample.net/en/b", "s://example.com/de/", "s://b.example.com/de/q#f",
    "s://example.com/fr/", "s://org/fr/x", "s://a.org/fr/", "s://a.org/FR/", "a://b://c/d", "s://h?q/net/", "s://h#net/", "://net/x",
    "s://İ.NET/ß", "line\nbreak://a.net/b", "s://a.net/" + "p" * 50_000,
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return host, tail[:stop]


def rule_of(host, path):
    fitting = []
    for rule in queries.URL_RULES:
        rule_host, _, rest = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rest):
            fitting.append(rule)
    return max(fitting, key=len, default=None)


def check(rows, got):
    for url, r in zip(rows, got, strict=True):
        host, path = parts(url)
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == rule_of(host, path)
        by_model = "block" if r["p_block"] > 0.5 else "allow"
        assert r["verdict"] == queries.URL_RULES.get(r["rule"], by_model)


def test_edge_addresses(spark):
    rows = [(k, u, "clash", "clash") for k, u in enumerate(URLS)]
    manifest = spark.createDataFrame(rows, SCHEMA)
    labelled = spark.createDataFrame([("s://bad.example/x", 1), ("s://good.example/x", 0), (None, None)] * 8, "url string, blocked int")
    got = url_filter.judge_urls(manifest, queries.URL_RULES, labelled).orderBy("name").collect()
    check(URLS, got)
    none = spark.createDataFrame([], "url string, blocked int")
    assert {r["p_block"] for r in url_filter.judge_urls(manifest, {}, none).collect()} == {0.5}
    assert url_filter.judge_urls(manifest.limit(0), queries.URL_RULES, labelled).collect() == []


def test_query(spark, sf_dir):
    pages = queries.table(spark, sf_dir, "pages").orderBy("page_id").collect()
    check([r["url"] for r in pages], queries.op8_url_filter(spark, sf_dir).orderBy("page_id").collect())


def test_model_on_addresses_it_has_not_seen(spark):
    urls = {r["url"] for r in queries.table(spark, "/root/testdata/sf0.1", "pages").collect()}
    rows = [(u, int(queries.URL_RULES[rule] == "block")) for u in sorted(urls) if (rule := rule_of(*parts(u)))]
    train, held = rows[::2], rows[1::2]
    model = url_filter.fit_model(spark.createDataFrame(train, "url string, blocked int"))
    sparse = url_filter.Sparse.of([url_filter.grams(*parts(u)) for u, _ in held])
    score = model.probability(sparse, url_filter.np.zeros((len(held), 0)))
    assert ((score > 0.5) == url_filter.np.array([b for _, b in held])).mean() > 0.97
