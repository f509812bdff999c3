import duckdb
import pandas as pd

from tessera.llm.queries import URL_RULES
from tessera.llm.url_filter import Rule, filter_urls, oracle_sql


def run(spark, urls, rules=URL_RULES):
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    return [r for r in sorted(filter_urls(df, rules).collect(), key=lambda r: r.page_id)]


def test_hosts_paths_and_rules(spark):
    cases = {
        None: ("", "", None), "": ("", "", None), "no scheme/net/": ("", "", None), "http://": ("", "", None),
        "http://A.Example.NET/en/1?x#y": ("a.example.net", "/en/1", "example.net/en/"), "http://example.net/EN/1": ("example.net", "/EN/1", "net/"),
        "http://net": ("net", "", None), "http://net/": ("net", "/", "net/"), "http://notnet/": ("notnet", "/", None), "http://x.net#/": ("x.net", "", None),
        "http://myexample.com/de/": ("myexample.com", "/de/", None), "http://www.example.com/de/2": ("www.example.com", "/de/2", "example.com/de/"),
        "a://b.org/fr/c://d.net/": ("b.org", "/fr/c://d.net/", "org/fr/"), "x\n://É.net/ü\n?": ("É.net", "/ü\n", "net/"),
    }
    got = run(spark, list(cases))
    assert [(r.host, r.path, r.rule) for r in got] == list(cases.values())
    verdicts = {r.name: r.verdict for r in URL_RULES}
    assert all(r.verdict == verdicts[r.rule] for r in got if r.rule)


def test_templates_follow_their_labels(spark):
    # under /ads every labelled page is blocked; the other branch is allowed
    rules = [Rule("block", "h.com", "/ads/x"), Rule("allow", "h.com", "/news/x")]
    urls = [f"http://h.com/ads/{p}{i}" for i in range(60) for p in ("x", "y")] + [f"http://h.com/news/{p}{i}" for i in range(60) for p in ("x", "y")] + ["http://other.com/a"]
    got = run(spark, urls, rules)
    by = lambda part: {r.verdict for r in got if f"/{part}/y" in r.path}
    assert by("ads") == {"block"} and by("news") == {"allow"} and got[-1].verdict == "allow"
    assert {r.template for r in got if "/ads/" in r.path} == {"/ads/*"}


def test_similar_branches_merge(spark):
    rules = [Rule("block", "h.com", "/a/x"), Rule("block", "h.com", "/b/x"), Rule("allow", "h.com", "/c/x")]
    urls = [f"http://h.com/{b}/{p}{i}" for b in "abc" for i in range(30) for p in ("x", "y")]
    nodes = {r.template: r.node for r in run(spark, urls[:120], rules)}
    assert nodes == {"/a/*": "/~/*", "/b/*": "/~/*"}
    apart = {r.template: r.node for r in run(spark, urls, rules)}
    assert apart["/c/*"] == "/c/*"


def test_trees_are_as_deep_as_frequent_prefixes_and_merge_at_every_node(spark):
    rules = [Rule("block", "h.com", f"/s/2020/{c}/list/x") for c in "ab"] + [Rule("allow", "h.com", "/s/2021/a/list/x")]
    urls = [f"http://h.com/s/{y}/{c}/list/{p}{i}" for y, c in (("2020", "a"), ("2020", "b"), ("2021", "a")) for i in range(30) for p in ("x", "y")]
    urls += [f"http://h.com/{'/'.join('abcdefgh')}/{i}/z" for i in range(4)] + ["http://h.com/s/2020/a/list/y1", "http://h.com/q/r/s/t"]
    got = run(spark, urls, rules)
    assert {r.template: r.node for r in got if "/list/" in r.path} == {"/s/2020/a/list/*": "/s/2020/~/list/*", "/s/2020/b/list/*": "/s/2020/~/list/*", "/s/2021/a/list/*": "/s/2021/a/list/*"}
    assert {r.verdict for r in got if r.path.startswith("/s/2020") and r.rule is None} == {"block"}
    assert {r.verdict for r in got if r.path.startswith("/s/2021")} == {"allow"}
    assert {r.template for r in got if r.path.startswith("/a")} == {"/*/b/c/d/e/f/g/**"} and got[-1].template == "/*/*/*/*"


def test_null_ids_and_columns_named_like_results(spark):
    df = spark.createDataFrame([(None, "http://a.net/x", 1, 2, 3), (1, None, 1, 2, 3)], "page_id long, url string, template int, node int, purity int")
    got = sorted(map(tuple, filter_urls(df, URL_RULES).select("page_id", "rule", "verdict", "template").collect()), key=repr)
    assert got == [(1, None, "allow", ""), (None, "net/", "block", "/*")]


def test_empty_repeated_and_no_rules(spark):
    assert run(spark, []) == []
    got = run(spark, ["http://a/b"] * 3, [])
    assert [(r.rule, r.verdict) for r in got] == [(None, "allow")] * 3


def test_wildcards_are_no_segments(spark):
    # frequent literals "*", "**" and "~" stay apart from rare segments, which become wildcards
    urls = [f"http://h.com/*/x{i}" for i in range(5)] + [f"http://h.com/y{i}/x{i}" for i in range(5)]
    urls += [f"http://g.com/{s}/{i}" for s in ("**", "~", "\\*", "~a", "") for i in range(4)]
    got = run(spark, urls, [])
    assert [{r.template for r in got[:5]}, {r.template for r in got[5:10]}] == [{"/\\*/*"}, {"/*/*"}]
    assert [r.template for r in got[10::4]] == ["/\\**/*", "/\\~/*", "/\\\\*/*", "/\\~a/*", "//*"]
    # a branch without labels that is named like the merged one
    rules = [Rule("block", "h.com", f"/{b}/x") for b in "ab"]
    urls = [f"http://h.com/{b}/{p}{i}" for b in "ab~" for i in range(60) for p in ("x", "y")]
    got = run(spark, urls, rules)
    assert {r.path[1]: (r.node, r.verdict) for r in got if r.rule is None} == {"a": ("/~/*", "block"), "b": ("/~/*", "block"), "~": ("/\\~/*", "allow")}
    pages = pd.DataFrame({"page_id": range(len(urls)), "url": urls})
    con = duckdb.connect()
    con.register("pages", pages)
    columns = ["page_id", "host", "path", "rule", "verdict", "template", "node", "purity"]
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({oracle_sql(rules)}) ORDER BY page_id").fetchall()
    assert [tuple(r[c] for c in columns[:-1]) for r in got] == [w[:-1] for w in want] and all(abs(r.purity - w[-1]) < 1e-12 for r, w in zip(got, want))


def test_few_labels_reject_nothing(spark):
    urls = ["http://example.com/de/a"] + [f"http://example.com/p{i}/y{i}" for i in range(60)]
    assert [r.verdict for r in run(spark, urls)] == ["block"] + ["allow"] * 60
    rules = [Rule("block", "h.com", "/q")]
    for labels, verdict in ((4, "allow"), (5, "allow"), (400, "block")):
        got = run(spark, [f"http://h.com/q{i}" for i in range(labels)] + [f"http://h.com/p{i}" for i in range(20)], rules)
        assert {r.verdict for r in got if r.rule is None} == {verdict}
