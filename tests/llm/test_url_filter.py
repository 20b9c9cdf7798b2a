import datetime as dt

from tessella.llm import url_filter as U

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)


def evaluate(spark, captures, entries):
    c = spark.createDataFrame([(i, u, f, "x") for i, (u, f) in enumerate(captures)], "page_id long, url string, fetched date, pattern string")
    e = spark.createDataFrame(entries, "pattern string, listed date, action string")
    return {r["page_id"]: (r["n_entries"], r["first_entry"]) for r in U.evaluate(c, e).collect()}


def test_entries_hold_at_fetch_time(spark):
    entries = [("Bad.com", D(10), "add"), ("bad.com", D(10), "add"), ("bad.com", D(20), "remove"), ("bad.com", D(30), "add"), ("bad.com", D(35), "add"), ("ok.org/a/b", D(0), "add"), ("same.net", D(5), "add"), ("same.net", D(5), "remove"), (None, D(1), "add"), ("x.y", None, "add"), ("z.z", D(1), "other"), ("gone.net", D(3), "remove")]
    captures = [
        ("http://bad.com/x", D(9)), ("http://bad.com/x", D(10)), ("https://u:p@www.BAD.com:80/x?q#f", D(19)), ("http://bad.com", D(20)), ("bad.com/a/b/c/d", D(36)), ("http://notbad.com/", D(36)),
        ("http://ok.org/a/b/c", D(1)), ("http://ok.org/a", D(1)), ("http://ok.org//a//b", D(1)), ("http://ok.org/ab", D(1)), ("http://same.net", D(6)), (None, D(6)), ("", D(6)), ("http://bad.com/", None), ("http://gone.net", D(9)), ("http://z.z/" + "a/" * 5000, D(9)),
    ]
    got = evaluate(spark, captures, entries)
    assert [got[i][0] for i in range(len(captures))] == [0, 1, 1, 0, 1, 0, 1, 0, 1, 0, 0, 0, 0, 0, 0, 0]
    assert got[2][1] == "bad.com" and got[6][1] == "ok.org/a/b"
    assert set(evaluate(spark, captures, []).values()) == {(0, None)} and evaluate(spark, [], entries) == {}


def test_repeated_captures_are_one(spark):
    c = spark.createDataFrame([(1, "http://a.b/c", D(1))] * 3, "page_id long, url string, fetched date")
    e = spark.createDataFrame([("a.b", D(0), "add"), ("b", D(0), "add")], "pattern string, listed date, action string")
    assert [tuple(r)[3:5] for r in U.evaluate(c, e).collect()] == [(2, "a.b")]
