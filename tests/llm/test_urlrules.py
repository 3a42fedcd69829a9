import random

import pytest

from corpusloom.llm import urlrules


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[end:]
    stop = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def brute(url, rules, default="allow"):
    host, path = cut(url)
    best = None
    for h, p, v in rules:
        if h is None or p is None or v is None or (p and not p.startswith("/")):
            continue
        h = h.lower()
        if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1,), (len(h + p), len(h), h + p, v))
    return (host, path, best[2], best[3]) if best else (host, path, None, default)


def some(seed, n_rules, n_urls):
    r = random.Random(seed)
    label = lambda: r.choice(["a", "b", "com", "org", "x-y", "A", "é"])
    host = lambda: ".".join(label() for _ in range(r.randint(1, 4)))
    path = lambda: "".join("/" + r.choice(["a", "ab", "b", "ab.c", ""]) for _ in range(r.randint(0, 4)))
    rules = [(host(), path(), r.choice(["allow", "block"])) for _ in range(n_rules)]
    rules += [(None, "/", "block"), ("a", None, "block"), ("b", "x", "block"), ("a", "/", None), rules[0], (rules[1][0], rules[1][1], "block")]
    urls = [f"http{r.choice(['', 's'])}://{host()}{path()}{r.choice(['', '?q=/a', '#x?/'])}" for _ in range(n_urls)]
    urls += [None, "", "no scheme", "://", "http://?x", "HTTP://A.Com", "a://b://c/d", "http://a.b:80/x", "http://.a./", "http://a.b/" + "ab/" * 20_000]
    return rules, urls + urls[:5]


@pytest.mark.parametrize("fold", [1000, 3])
def test_equals_brute_force(spark, monkeypatch, fold):
    monkeypatch.setattr(urlrules, "FOLD", fold)
    rules, urls = some(fold, 80, 300)
    pages = spark.createDataFrame([(i, u, "h", 1, "k") for i, u in enumerate(urls)], "page_id long, url string, host string, block int, key string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    found = {x.page_id: tuple(x)[1:] for x in urlrules.judged(pages, table).collect()}
    assert found == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_rule_for_every_host(spark):
    rules = [("", "/a", "block"), ("b", "", "allow")]
    urls = ["http://x/a", "http://b/a", "http://b", "http://x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = [tuple(x)[1:] for x in urlrules.judged(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), "block").orderBy("page_id").collect()]
    assert found == [brute(u, rules, "block") for u in urls]


def test_empty_tables_and_repeated_ids(spark):
    rules = spark.createDataFrame([("a", "/", "block")], "host string, path string, verdict string")
    none = spark.createDataFrame([], "page_id long, url string")
    assert urlrules.judged(none, rules).count() == 0
    pages = spark.createDataFrame([(1, "x://a/"), (1, "x://a/"), (None, None)], "page_id long, url string")
    assert sorted((x.page_id or 0, x.verdict) for x in urlrules.judged(pages, rules).collect()) == [(0, "allow"), (1, "block"), (1, "block")]
    assert {x.verdict for x in urlrules.judged(pages, rules.limit(0)).collect()} == {"allow"}


def test_query(spark, tmp_path):
    from corpusloom.llm.queries import QUERIES, URL_RULES

    urls = ["http://a.example.org/es/1", "http://example.org/en/12", "http://org/x", "http://q.com/fr/", "http://q.com/de/?x", "http://net/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {x.page_id: tuple(x)[1:] for x in QUERIES["op13_url_rules"](spark, str(tmp_path)).collect()}
    assert found == {i: brute(u, URL_RULES) for i, u in enumerate(urls)}
