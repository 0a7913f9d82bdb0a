from pyspark.sql import functions as F

from gleaner.functions import keys, searchurl, text


def values(spark, f, *inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in rows.select(f(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


def test_titles(spark):
    assert values(spark, text.title_text, "AI Engineer AI Engineer with verification", "Data Data", "abc abc", "DataData", "Data Lead|Data Lead", "Renew", None) == [
        "AI Engineer", "Data", "abc abc", "Data", "Data Lead", "Re", ""
    ]


def test_badges_stop_after_four(spark):
    assert values(spark, text.without_badges, "x promoted viewed new verified reposted", " Easy Apply", "x NEW") == ["x promoted", "", "x"]


def test_squeeze_takes_all_spaces(spark):
    assert values(spark, text.squeeze, " a\u00a0\u2003b\n c ", None, "\ufeff") == ["a b c", "", ""]


def test_labels(spark):
    got = values(spark, text.bullet_label, "<b>X</b>: y", "<b>X::</b>", "  <b> X : </b>", "x <b>Y</b>", "<b>two\nlines</b>", None)
    assert got == ["X", "X:", "X :", "", "", ""]


def test_escape_and_names(spark):
    assert values(spark, text.escape_html, "<a & 'b' \"c\">", None) == ["&lt;a &amp; &#x27;b&#x27; &quot;c&quot;&gt;", ""]
    assert values(spark, text.base_name, "a/b.pdf", "a/b/", "/", "x") == ["b.pdf", "b", "", "x"]


def test_keys_differ_in_closing_slashes(spark):
    url = "HTTP://X/a//?q=1"
    assert [values(spark, k, url)[0] for k in (keys.store_key, keys.page_key, keys.lookup_key, keys.mark_key)] == ["http://x/a//", "http://x/a", "http://x/a/", url]
    assert values(spark, keys.store_key, None, "?x") == ["", ""]
    assert values(spark, keys.page_key, "http://x/a/\n") == ["http://x/a/\n"]


def test_identity_parameters_are_an_option(spark):
    f = lambda c: keys.store_key(c, ["jk"])
    assert values(spark, f, "https://de.indeed.com/viewjob?jk=A1&x=2", "https://x/y?z=1") == ["https://de.indeed.com/viewjob?jk=a1", "https://x/y"]


def test_current_job(spark):
    got = values(
        spark, keys.current_job, "https://www.linkedin.com/jobs/search/?currentJobId=7", "https://www.linkedin.com/jobs/", "https://de.indeed.com/x", "https://www.stepstone.de/jobs/x",
        "https://www.stepstone.de/stellenangebote--a?b=1", "https://example.org/", "not a url", None,
    )
    assert got == ["https://www.linkedin.com/jobs/view/7/", None, "https://de.indeed.com/x", None, "https://www.stepstone.de/stellenangebote--a", None, None, None]


def test_progress_takes_the_last_fraction(spark):
    assert values(spark, text.progress, "page 2/3 · job 12/25", "job 30/25", "1/0", "loading", "", None) == [(48.0, False), (100.0, False), (None, True), (None, True), (None, None), (None, None)]


def test_search_addresses(spark):
    rows = spark.createDataFrame([("stepstone", " Data  Lead ", "Köln", 30, 7, True), ("linkedin", "a b", "", 30, 0, False), ("indeed", "a&b", None, 0, 1, None), ("indeed", " ", "x", 1, 1, True), ("x", "a", "", 0, 0, False)],
                                 "site string, kw string, loc string, radius int, posted int, remote boolean")
    got = [r[0] for r in rows.select(searchurl.search_url(*[F.col(c) for c in rows.columns])).collect()]
    assert got == [
        "https://www.stepstone.de/jobs/data-lead/in-k%C3%B6ln?radius=30&ag=604800&wfh=1", "https://www.linkedin.com/jobs/search/?keywords=a+b&distance=19",
        "https://de.indeed.com/jobs?q=a%26b&fromage=1", None, None,
    ]


def test_page_numbers(spark):
    rows = spark.createDataFrame([(0,), (-4,), (3,), (99,), (None,)], "n int")
    assert [r[0] for r in rows.select(searchurl.pages(F.col("n"))).collect()] == [3, 1, 3, 15, 3]
