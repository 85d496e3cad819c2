"""Spellings of one list entry, and URLs of any length."""

from tessera.llm import urls

EVENTS = [
    ("domain", "Foo.com", "add", "2024-01-01"), ("domain", "foo.com.", "add", "2024-01-05"), ("domain", "FOO.COM", "remove", "2024-02-01"),
    ("prefix", "Bar.org/A/b/", "add", "2024-01-01"), ("prefix", "bar.org//A/b", "add", "2024-01-02"), ("prefix", "baz.net", "add", "2024-01-01"),
    ("prefix", "/", "add", "2024-01-01"),
]


def events(spark):
    return spark.createDataFrame(EVENTS, "kind string, value string, action string, at string").selectExpr("kind", "value", "action", "cast(at as date) at")


def test_spellings_are_one_entry(spark):
    assert sorted((r.kind, r.value, str(r.valid_from), str(r.valid_to)) for r in urls.intervals(events(spark)).collect()) == [
        ("domain", "foo.com", "2024-01-01", "2024-02-01"), ("prefix", "bar.org/A/b", "2024-01-01", "None"), ("prefix", "baz.net/", "2024-01-01", "None"),
    ]
    deep = "http://bar.org/A/b" + "/" * 100_000 + "/".join("c" * 50_000)
    many = "http://" + "a." * 20_000 + "foo.com/x"
    caps = [
        ("http://www.foo.com/x", "2024-01-31"), ("http://www.foo.com/x", "2024-02-01"), (deep, "2024-03-01"), (many, "2024-01-10"),
        ("http://BAR.org/a/b", "2024-03-01"), ("http://bar.org/A", "2024-03-01"), ("http://baz.net", "2024-03-01"), ("http://x.baz.net/", "2024-03-01"),
    ]
    df = spark.createDataFrame(caps, "url string, at string").selectExpr("url", "cast(at as date) fetched_at")
    got = {(r.url, str(r.fetched_at)): (r.n_entries, r.entry) for r in urls.evaluate(df, events(spark)).collect()}
    assert [got[c] for c in caps] == [
        (1, "domain:foo.com"), (0, None), (1, "prefix:bar.org/A/b"), (1, "domain:foo.com"), (0, None), (0, None), (1, "prefix:baz.net/"), (0, None),
    ]
