"""Rules, hosts and paths, and groups of addresses."""

from freshet.llm.redirects import verdicts


def canonical(href):
    return f'<html><head><link href="{href}" rel="canonical"></head></html>'


def refresh(url):
    return f"<meta http-equiv='refresh' content='0; URL={url}'>"


ROWS = [
    (0, "http://WWW.Example.com/en/a?x#y", None, "www.example.com", "/en/a", "www.example.com/en/", "allow"),
    (1, "http://m.example.com/en/a", "", "m.example.com", "/en/a", "example.com/en/", "block"),
    (2, "http://notexample.com/en/a", "", "notexample.com", "/en/a", "com/", "allow"),
    (3, "https://a.net/es/1", "", "a.net", "/es/1", "net/es/", "block"),
    (4, None, canonical("http://a.net/es/1"), "", "", None, "allow"),
    (5, "no scheme", canonical("http://a.net/es/1"), "", "", None, "allow"),
    # 6 -> 7 -> blocked a.net/es/1: both are blocked, through another page
    (6, "http://x.org/1", canonical("https://x.org/2#frag"), "x.org", "/1", None, "block"),
    (7, "http://x.org/2", refresh("http://a.net/es/1"), "x.org", "/2", None, "block"),
    # a group with an allowed and a blocked address is allowed, but for the page with a rule
    (8, "http://y.org/1", canonical("http://a.net/fr/9"), "y.org", "/1", None, "allow"),
    (9, "http://y.org/2", refresh("http://y.org/1"), "y.org", "/2", None, "allow"),
    (10, "http://b.com/z", canonical("http://y.org/2"), "b.com", "/z", "com/", "allow"),
    (11, "http://a.net/fr/9", "", "a.net", "/fr/9", "net/fr/", "block"),
    # relative links
    (12, "http://c.net/de/p/1", canonical("/es/q"), "c.net", "/de/p/1", None, "block"),
    (13, "http://d.org?q=1", canonical("//a.net/es/1"), "d.org", "", None, "block"),
    (14, "http://free.org/", "<link rel=stylesheet href='http://a.net/es/1'>", "free.org", "/", None, "allow"),
    (15, "http://x.org/1", "", "x.org", "/1", None, "block"),
    (16, "http://.net/es/", "", ".net", "/es/", "net/es/", "block"),
    (17, "ftp://e.net/esx", "", "e.net", "/esx", None, "allow"),
    (None, "http://x.org/2#top", None, "x.org", "/2", None, "block"),
]


def test_verdicts(spark):
    pages = spark.createDataFrame([(*r[:3], "clash") for r in ROWS], "page_id long, url string, html string, host string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in verdicts(pages).collect()}
    assert got == {(r[0], *r[3:]) for r in ROWS}


def test_empty(spark):
    assert verdicts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
