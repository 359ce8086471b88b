import random
import re

from pyspark.sql import functions as F

from colscope.llm import urls
from colscope.llm.queries import _URL_PATTERNS
from colscope.llm.urls import judge, match_patterns, pattern_table, rule_index

SAMPLES = [
    None, "", "no scheme", "http://", "HTTP://ExAmPle.ORG", "http://www.example.org/es/1?x#y", "http://example.org/en/12",
    "http://example.org/en/", "https://a.com/fr/1", "https://a.com/de/1", "https://com/de/", "http://xcom/de/", "http://net/x",
    "http://www.cheap-pills.net/a", "http://xcheap-pills.net/a", "http://a.net/cheap-pills.", "http://casino.net",
    "http://a.net/x.EXE", "http://a.net/x.exe?y", "http://a.net/xxx", "http://a.net/xxx/1", "http://a.net/xxxl", "http://a.net/xxx-1",
    "http://a.net/torrent/1/magnet", "http://a.net/?sessionid=9", "http://a.net/q?a=1&sid=2&z=3&tracking=1", "http://a.net\n/adserver/",
    "x://y://org/", "http://a.net/.git/config", "http://a.net/wp-login.php", "http://a.net/wp-loginxphp", "http://org",
]


def brute(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host, path = (found[1].translate(low), found[2]) if found else ("", "")
    best = None
    for action, rule in urls.HOST_RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = (action, rule)
    hits = sorted(p for p, x in _URL_PATTERNS.items() if url is not None and re.search(x.replace("$)", r"\Z)"), url.translate(low)))
    return host, path, best and best[1], best[0] if best else ("block" if hits else "allow"), hits[0] if hits else None


def test_verdicts_equal_brute_force(spark):
    pick = random.Random(3)
    pieces = ["/", ".", "-", "?", "&", "cheap", "pills", "casino", "xxx", "exe", "org", "com", "de", "fr", "sessionid=", "adserver", "*", "^"]
    made = SAMPLES + ["http://" + "".join(pick.choice(pieces) for _ in range(pick.randint(1, 9))) for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    rows = judge(pages, pattern_table(spark, urls.PATTERNS)).collect()
    assert len(rows) == len(made)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict, r.pattern) == brute(made[r.page_id]), made[r.page_id]


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = spark.createDataFrame([(i, f"http://common.net/{i}/rare" if i == 3 else f"http://common.net/{i}/") for i in range(20)],
                                  "page_id long, url string")
    own = pages.select(F.split("url", "[^a-z0-9]+").alias("tokens"))
    index = {r.pattern: r.token for r in rule_index(pattern_table(spark, ["/common.net/rare^", "*part*", "||common.^"]), own).collect()}
    assert index == {"/common.net/rare^": "rare", "*part*": "", "||common.^": "common"}


def test_partial_tokens_are_not_used(spark):
    pages = spark.createDataFrame([(1, "http://a.net/xpartx"), (2, "http://a.net/part")], "page_id long, url string")
    assert {r.url for r in match_patterns(pages, pattern_table(spark, ["part"])).collect()} == {r.url for r in pages.collect()}


def test_separators_fit_at_either_end_and_hosts_end_at_the_path(spark):
    pages = spark.createDataFrame(list(enumerate(["http://a.net/q?ads=1", "http://a.net/zz/ads?x", "http://a.net/ads", "http://a.net/xads/",
                                                  "http://x.host.net/", "http://host.net/", "http://a.net/x.host."])), "page_id long, url string")
    found = {(r.url, r.pattern) for r in match_patterns(pages, pattern_table(spark, ["^ads^"])).collect()}
    assert {u for u, _ in found} == {"http://a.net/q?ads=1", "http://a.net/zz/ads?x", "http://a.net/ads"}
    found = {r.url for r in match_patterns(pages, pattern_table(spark, ["||host."])).collect()}
    assert found == {"http://x.host.net/", "http://host.net/"}


def test_shuffled_index_gives_the_same(spark, monkeypatch):
    pages = spark.createDataFrame(list(enumerate(SAMPLES)), "page_id long, url string")
    rules = pattern_table(spark, urls.PATTERNS)
    first = sorted(map(tuple, match_patterns(pages, rules).collect()))
    monkeypatch.setattr(urls, "MAX_BROADCAST_RULES", 0)
    assert sorted(map(tuple, match_patterns(pages, rules).collect())) == first


def test_odd_rows(spark):
    schema = "page_id long, url string, host string, token string, u string, i int"
    pages = spark.createDataFrame([(1, None, None, None, None, None), (None, "http://a.org/", "h", "t", "u", 1),
                                   (2, "http://casino.net/", "h", "t", "u", 1), (2, "http://casino.net/", "h", "t", "u", 1)], schema)
    rules = pattern_table(spark, urls.PATTERNS)
    rows = judge(pages, rules).collect()
    assert sorted((r.page_id or 0, r.verdict, r.rule) for r in rows) == [
        (0, "allow", "org/"), (1, "allow", None), (2, "block", None), (2, "block", None)]
    assert judge(pages.limit(0), rules).count() == 0 and judge(pages, rules.limit(0)).filter("pattern is not null").count() == 0
    assert "Python" not in judge(pages, rules)._jdf.queryExecution().executedPlan().toString()
