import re
import pytest

from cohort.llm import url_filter as u
from cohort.llm.registry import URL_RULES

PLAIN = [(r.verdict, r.text) for r in URL_RULES]


def brute(url):
    """The host and path rules by plain string tests."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    end = min([rest.find(c, cut) for c in "?#" if rest.find(c, cut) >= 0], default=len(rest))
    path = rest[cut:end]
    fits = [t for _, t in PLAIN for h, p in [t.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, max(fits, key=len, default=None)


URLS = [
    None, "", "no scheme", "://", "http://", "http://COM/", "http://com", "http://a.com/x?y://net/es/", "http://WWW.Example.com/en/1", "http://www.example.com/EN/1",
    "http://example.com/en/", "http://example.com/en", "http://xexample.com/en/", "http://a.b.example.com/en/q#f", "https://x.net/es/1", "https://xnet/es/1", "https://net/fr/",
    "ftp://u:p@x.com/", "http://x.com:80/", "http://x.org/://a.com/", "http://casino-win.example.org/", "http://mycasinos.org/", "http://ads-track.example.com/en/2",
    "http://Ads-Track.test/", "http://x.org/casino/", "http://é.com/ü", "http://x.com/\n", "http://" + "a." * 50_000 + "com/",
]


@pytest.mark.parametrize("local", [u.LOCAL_RULES, 0])
def test_urls(spark, local):
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate([*URLS, URLS[5], URLS[5]])], "page_id long, url string, host string")
    rules = URL_RULES + list(u.KEYWORDS)
    out = u.judge_urls(df, rules, local_rules=local)
    got = {r.page_id: r for r in out.collect()}
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"] and len(got) == len(URLS) + 2
    for i, x in enumerate(URLS):
        r, (host, path, rule) = got[i], brute(x)
        assert (r.host, r.path, r.rule) == (host, path, rule), x
        if rule:
            assert r.verdict == dict((t, v) for v, t in PLAIN)[rule]
    verdict = {x: got[i].verdict for i, x in enumerate(URLS)}
    assert verdict["http://casino-win.example.org/"] == verdict["http://Ads-Track.test/"] == "block"
    assert verdict["http://mycasinos.org/"] == verdict["http://x.org/casino/"] == verdict[None] == verdict[""] == "allow"
    assert verdict["http://ads-track.example.com/en/2"] == "block"


def test_index_uses_the_rarest_literal(spark):
    urls = spark.createDataFrame([("http://a.example.com/",), ("http://b.example.com/",), ("http://a.com/",)], "url string")
    rules = [u.host_rule("block", "example.com/"), u.Rule("any", "block", "zz", (), 0)]
    counts = u.token_counts(urls, rules)
    assert counts == {"example": 2, "com": 3}
    assert {k: [r.text for r in v] for k, v in u.build_index(rules, counts).items()} == {"example": ["example.com/"], "": ["any"]}


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    for local in (u.LOCAL_RULES, 0):
        assert u.judge_urls(df, URL_RULES, local_rules=local).count() == 0
    with pytest.raises(ValueError):
        u.host_rule("block", "nohost")


def test_index_has_the_path(spark):
    """Rules of one host are told apart by their path's literals, where these end inside the rule."""
    rules = [u.host_rule("block", t) for t in ("net/es/", "net/fr/", "net/en", "net/a-b/c/d")]
    assert [r.tokens for r in rules] == [("net", "es"), ("net", "fr"), ("net",), ("net", "a", "b", "c")]
    urls = spark.createDataFrame([(f"http://x{i}.net/" + ("es/" if i % 9 == 0 else ""),) for i in range(90)], "url string")
    index = u.build_index(rules[:2], u.token_counts(urls, rules))
    assert set(index) == {"es", "fr"}
    got = {r.url: r.verdict for r in u.judge_urls(urls, rules).collect()}
    assert all((v == "block") == ("/es/" in url) for url, v in got.items())


@pytest.mark.parametrize("local", [u.LOCAL_RULES, 0])
def test_only_ascii_letters_have_small_ones(spark, local):
    """The Kelvin sign and the dotted capital I are lower-cased into ASCII by Unicode, but are no letters of the rules."""
    urls = ["http://\u212aasino.org/", "http://x\u212acasino.org/", "http://CASINO.org/", "http://\u0130casino.org/", "http://EXAMPLE.com/EN/", "http://example.com/en/"]
    rules = [u.host_rule("block", "example.com/en/"), *u.KEYWORDS]
    df = spark.createDataFrame([(x,) for x in urls], "url string")
    got = {r.url: r.verdict for r in u.judge_urls(df, rules, local_rules=local).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for url in urls:
        host, _, path = url[7:].partition("/")
        blocked = (host.translate(low) == "example.com" and path.startswith("en/")) or re.search("(^|[^0-9a-z])casino($|[^0-9a-z])", host.translate(low))
        assert (got[url] == "block") == bool(blocked), url
