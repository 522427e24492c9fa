"""Line windows and URL rules: edge cases; the SQL twins cover the given tables."""

from pyspark.sql import functions as F

from loamlog.llm import linededup, urlfilter

DOCS = "doc_id long, text string, n_lines string, starts long"


def deduped(spark, *rows):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    found = linededup.dedup_lines(frame)
    assert sorted(found.columns) == ["doc_id", "n_lines", "n_removed", "starts", "text"]
    return sorted(
        ((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in found.collect()),
        key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""),
    )


def test_later_windows_go_and_overlaps_merge(spark):
    assert deduped(spark, (1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "b\nc")) == [
        (1, "a\nb\nc\nd", 4, 0),
        (2, "x\ny", 6, 4),
        (3, "b\nc", 2, 0),
    ]


def test_a_text_repeats_itself(spark):
    assert deduped(spark, (1, "a\na\na\na\na\nb")) == [(1, "a\nb", 6, 4)]


def test_nulls_empty_ties_and_repeated_rows(spark):
    rows = [(None, "a\nb\nc"), (5, None), (5, ""), (2, "a\nb\nc"), (2, "a\nb\nc"), (4, "\n\n\n\n"), (6, "\n\n\n")]
    assert deduped(spark, *rows) == [
        (2, "a\nb\nc", 3, 0),
        (2, "a\nb\nc", 3, 0),
        (4, "\n\n\n\n", 5, 0),
        (5, None, 0, 0),
        (5, "", 1, 0),
        (6, "\n\n\n", 4, 0),
        (None, "", 3, 3),
    ]


def test_very_long_text(spark):
    line = "\n".join(str(i) for i in range(30_000))
    found = deduped(spark, (1, line), (2, line + "\nnew"))
    assert [(r[0], r[2], r[3]) for r in found] == [(1, 30_000, 0), (2, 30_001, 30_000)]
    assert found[1][1] == "new"


def test_empty_tables(spark):
    assert deduped(spark) == []
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([], "verdict string, host string, path string")
    assert urlfilter.judge_urls(pages, rules).collect() == []


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id int, url string, rule string")
    rules = spark.createDataFrame(rules, "verdict string, host string, path string")
    found = urlfilter.judge_urls(pages, rules).orderBy("page_id")
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()]


def test_rules_and_precedence(spark):
    rules = [
        ("allow", "org", "/"),
        ("block", "Example.org", "/en/1"),
        ("block", "a.b", None),
        ("allow", "a.b", ""),
        ("block", None, "/"),
        ("block", "", "/"),
    ]
    urls = [
        "http://www.EXAMPLE.org/en/17?x#y",
        "http://example.org/EN/17",
        "http://example.org",
        "http://notexample.org/en/1",
        "x://c.a.b?q=http://org/",
        "http://org/",
        None,
        "",
        "org/en",
        "http://" + "l." * 2000 + "org/" + "p/" * 5000,
        "http://www.EXAMPLE.org/en/17?x#y",
    ]
    found = judged(spark, urls, rules)
    assert found[0] == found[10] == ("www.example.org", "/en/17", "example.org/en/1", "block")
    assert found[1] == ("example.org", "/EN/17", "org/", "allow")
    assert found[2] == ("example.org", "", None, "allow")
    assert found[3] == ("notexample.org", "/en/1", "org/", "allow")
    assert found[4] == ("c.a.b", "", "a.b", "block")
    assert found[5] == ("org", "/", "org/", "allow")
    assert found[6] == found[7] == found[8] == ("", "", None, "allow")
    assert found[9][2:] == ("org/", "allow")


def test_no_rules_give_the_default(spark):
    assert judged(spark, ["http://a.b/c", None], []) == [("a.b", "/c", None, "allow"), ("", "", None, "allow")]


def test_shuffled_rules_judge_alike(spark, monkeypatch):
    rules = [("block", "a.b", "/x"), ("allow", "b", "/")]
    urls = ["http://a.b/xy", "http://c.b/xy"]
    before = judged(spark, urls, rules)
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", 0)
    assert judged(spark, urls, rules) == before == [("a.b", "/xy", "a.b/x", "block"), ("c.b", "/xy", "b/", "allow")]


def test_salted_windows_are_never_broadcast(spark):
    """16 copies of each repeated window, which Spark sizes as the windows alone."""
    text = F.concat_ws("\n", *[F.concat(F.lit(f"{i} "), F.col("id") % 7) for i in range(5)])
    rows = spark.range(100).select(F.col("id").alias("doc_id"), text.alias("text"))
    found = linededup.repeated_starts(rows, "doc_id", "text")
    assert sum(len(r["starts"]) for r in found.collect()) == 3 * (100 - 7)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
