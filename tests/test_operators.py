import gc
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.functions import keys
from gleaner.operators import batch, collect, gate, layout, marks, run, store
from gleaner.sources import html, payloads, schema


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_overlapping_selectors_count_once(spark):
    cards = spark.createDataFrame([(1, 0, "a", "http://x/1?r=2"), (1, 1, "a", "http://x/1/"), (2, 0, "a", "http://x/1"), (1, 2, "", "http://x/2"), (1, 3, "b", None)], "page_no int, pos int, title string, url string")
    assert rows(collect.collect_cards(cards), "page_no", "pos") == [(1, 0), (2, 0)]
    assert rows(collect.visible(collect.union_cards(cards, cards.withColumn("pos", F.col("pos") + 10))), "page_no", "visible") == [(1, 1), (2, 1)]


def test_detail_text_needs_more_than_300(spark):
    one = spark.createDataFrame([("a" * 300, "b" * 301), (None, "  " + "c" * 301 + "\n\n\n\nd"), ("", "")], "a string, b string")
    got = [r[0] for r in one.select(collect.detail_text(F.col("a"), F.col("b"))).collect()]
    assert got == ["b" * 301, "c" * 301 + "\n\nd", ""]
    assert [r[0] for r in one.select(collect.pane_ready(F.lit(" " + "x" * 200))).collect()][0] is False


def test_upsert_against_a_fold(spark):
    rng = random.Random(3)
    seen = [(f"http://x/{rng.randrange(6)}{rng.choice(['', '/', '?a=1'])}", rng.choice(["t1", "", "t2"]), rng.choice(["", None, "d1", "d2"]), i) for i in range(200)]
    want, first = {}, {}
    for url, title, d, i in seen:
        key = url.split("?")[0].lower()
        want[key] = {"title": title, "url": url, "description": d or want.get(key, {}).get("description", ""), "seq": i}
        first.setdefault(key, i)
    df = spark.createDataFrame([(t, "c", "l", u, "s", "q", d, i) for u, t, d, i in seen], "title string, company string, location string, url string, source string, query string, description string, seq bigint")
    expected = sorted((k, v["title"], v["url"], v["description"], v["seq"], first[k]) for k, v in want.items())
    names = ("key", "title", "url", "description", "seq", "first_seq")
    key = keys.store_key(F.col("url"))
    assert rows(store.latest(df, key), *names) == expected
    half = store.latest(df.filter("seq < 90"), key)
    twice = store.upsert(store.upsert(half, df.filter("seq >= 90")), df.filter("seq >= 150"))  # a batch that comes again
    assert rows(twice, *names) == expected


def test_marks_against_a_fold(spark):
    rng = random.Random(5)
    events = [(f"u{rng.randrange(5)}", rng.choice(["applied", "skipped"]), rng.random() < 0.6, i) for i in range(300)]
    state = {}
    for url, kind, on, _ in events:
        st = state.setdefault(url, {"applied": False, "skipped": False})
        st[kind] = on
        if on:
            st["skipped" if kind == "applied" else "applied"] = False
    df = spark.createDataFrame(events, "url string, kind string, checked boolean, seq int")
    folded = marks.fold(df)
    assert rows(folded, "url", "applied", "skipped") == sorted((u, s["applied"], s["skipped"]) for u, s in state.items())
    assert folded.filter("applied AND skipped").isEmpty()
    reset = df.unionByName(spark.createDataFrame([("u1", "reset", True, 999)], df.schema))
    assert rows(marks.fold(reset).filter("url = 'u1'"), "applied", "skipped") == [(False, False)]


def test_cards_without_address_share_marks(spark):
    cards = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, "b")], "id int, url string")
    m = spark.createDataFrame([("", True, False), ("a", False, True)], "url string, applied boolean, skipped boolean")
    marked = marks.with_marks(cards, m)
    assert rows(marked, "id", "done") == [(1, True), (2, True), (3, True), (4, False)]
    assert tuple(marks.counts(marked).first()) == (2, 1, 1, 50.0, 25.0)
    assert tuple(marks.counts(marked.limit(0)).first()) == (0, 0, 0, 0.0, 0.0)
    assert rows(marks.hide_done(marked), "id") == [(4,)]


CV = """{"name": "N", "sections": [{"type": "experience", "title": "Work", "items": [{"role": "R", "org": "O", "bullets": %s}]},
{"type": "education", "title": "School", "items": [{"role": "S", "bullets": ["<b>Zeta:</b> x"]}]}, {"type": "skills", "title": "Skills", "items": [["Tools", "a, b"]]}]}"""


@pytest.fixture
def cvs(spark, tmp_path):
    texts = {"ok": ["<b>A:</b> 1", "<b>B</b> 2", "<b>C:</b> 3", "none"], "over": ["<b>A:</b> 1"] * 3 + ["<b>B:</b>", "<b>C:</b>"], "few": ["<b>A:</b>", "<b>a:</b>"],
             "topic": ["<b>RELIABILITY work:</b>", "<b>Agent loop:</b>", "<b>X:</b>"], "none": ["plain"]}
    import json

    for k, b in texts.items():
        (tmp_path / k).mkdir()
        (tmp_path / k / "cv.json").write_text(CV % json.dumps(b))
    return payloads.parse_cv(payloads.raw_payloads(spark, f"{tmp_path}/*/cv.json"))


def test_gate(spark, cvs):
    found = gate.problems(cvs, gate.labels(gate.bullets(cvs)))
    got = sorted((r["path"].split("/")[-2], r["problem"].split("/")[-1]) for r in found.collect())
    assert got == [
        ("few", "few: only 2 distinct projects, minimum is 3"), ("none", "cv.json: no labelled bullets found"), ("over", "over: 'A' appears 3 times, limit is 2"),
        ("topic", "topic: topic labels, not project names: Agent loop, RELIABILITY work"),
    ]
    assert tuple(gate.verdict(found).first()) == (False, 4)
    assert gate.verdict(found.limit(0)).first()["ok"]
    assert {r["ungated_sections"] for r in gate.ungated_sections(cvs).collect()} == {1}


def test_cv_layout_rows(spark, cvs):
    got = [tuple(r) for r in layout.cv(cvs.filter(F.col("path").contains("/few/"))).orderBy("ord").select("style", "text").collect()]
    assert got == [
        ("name", "N"), ("rule", ""), ("section", "WORK"), ("rule", ""), ("role", "R, O"), ("bullet", "<b>A:</b>"), ("bullet", "<b>a:</b>"), ("section", "SCHOOL"), ("rule", ""), ("role", "S"),
        ("bullet", "<b>Zeta:</b> x"), ("section", "SKILLS"), ("rule", ""), ("skill", "<b>Tools:</b> a, b"),
    ]


def test_payload_faults_are_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name": "N"}')
    (tmp_path / "b.json").write_text("not json")
    got = {r["path"][-6:]: (r["missing"], r["corrupt"]) for r in payloads.parse_cv(payloads.raw_payloads(spark, str(tmp_path))).collect()}
    assert got == {"a.json": (["sections"], False), "b.json": (["name", "sections"], True)}
    dashes = spark.createDataFrame([('{"a": "x — y--"}',), ('{"a--b": 1}',), ("{}",)], "raw string")
    assert [r[0] for r in dashes.select(gate.forbidden_dash(F.col("raw"))).collect()] == ["—", "--", None]


BATCH = """{"pool_size": 24, "built": [{"rank": 2, "company": "A & B", "title": "T1", "url": "http://x/1", "why": "fits", "flags": ["one", "two"], "files": {"zCV": "out/cv.pdf", "Letter": "out/l.pdf", "No": ""}},
{"rank": 0, "company": null, "title": "T2", "flags": null}, {"rank": 1, "title": "<T3>", "url": ""}], "dropped": [{"company": "C", "title": "T", "reason": "far"}]}"""


def test_batch(spark, tmp_path):
    (tmp_path / "b.json").write_text(BATCH)
    b = payloads.parse_batch(payloads.raw_payloads(spark, str(tmp_path)), "2026-01-02")
    c = batch.cards(b)
    assert [tuple(r) for r in c.orderBy("input_pos").select("date", "title", "n_flags", F.transform("files", lambda f: f["label"])).collect()] == [
        ("2026-01-02", "T1", 2, ["zCV", "Letter"]), ("2026-01-02", "T2", 0, []), ("2026-01-02", "<T3>", 0, [])
    ]
    assert [r["title"] for r in batch.ranked(c).collect()] == ["<T3>", "T1", "T2"]
    assert [r["title"] for r in batch.matching(c, " A & b ").collect()] == ["T1"]
    assert batch.matching(c, "none none").count() == 2
    page = batch.report(b).first()["html"]
    assert page.count('<article class="card"') == 3 and "&lt;T3&gt;" in page and "from a pool of 24" in page and page.index("T1") < page.index("T2")
    assert tuple(batch.sizes(b).first()) == ("2026-01-02", 3, 1, 24)


def test_runs_expire_at_twenty_minutes(spark):
    age = spark.createDataFrame([(0,), (20 * 60 * 1000,), (20 * 60 * 1000 + 1,)], "age bigint")
    got = [r[0] for r in age.select(run.resumable(F.lit(10_000_000).cast("bigint") + F.col("age"), F.lit(10_000_000).cast("bigint"), F.lit(1))).collect()]
    assert got == [True, True, False]
    assert not age.select(run.resumable(F.lit(5), F.lit(None).cast("bigint"), F.lit(1))).first()[0]


def test_stop_keeps_what_came_before(spark):
    events = spark.createDataFrame([("a", i, i == 3) for i in range(6)] + [("b", 0, False)], "run string, pos int, stop boolean")
    assert rows(run.before_stop(events, F.col("stop"), "pos", ["run"]), "run", "pos") == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]


def test_padding(spark):
    n = spark.createDataFrame([(0,), (8191,), (8192,), (9000,)], "n bigint")
    assert [r[0] for r in n.select(layout.finished_size(F.col("n"))).collect()] == [8258, 8258, 8192, 9000]


LIST = """<ul><li data-occludable-job-id="1"><div class="job-card-container"><a class="job-card-list__title" href="/jobs/view/1/?t=2"><b>Dev&nbsp;Lead</b> Dev Lead Promoted</a><p class="z-subtitle">Acme</p></div></li>
<li data-occludable-job-id="2"><script>x</script>no link</li></ul><button aria-label='View next page'>&gt;</button>"""


def test_pages(spark):
    pages = spark.createDataFrame([("https://www.linkedin.com/jobs/search/?keywords=dev", LIST, 1), ("https://example.org", LIST, 2), ("https://www.linkedin.com/", None, 3)], "url string, html string, page_no int")
    cards = html.scan_cards(pages)
    assert cards.count() == 2  # the nested selectors give one card twice
    assert [tuple(r) for r in collect.collect_cards(cards).collect()] == [(1, 0, "Dev Lead", "Acme", "", "https://www.linkedin.com/jobs/view/1/", "LinkedIn", "dev")]
    assert html.read_page(html.SITES["linkedin"], LIST)[3] is True


def test_cards_without_a_link_are_counted_and_not_scanned(spark, monkeypatch):
    linkless = "<div class='job_seen_beacon'><h2 class='jobTitle'>T</h2></div>"
    linked = "<td class='resultContent'><a data-jk='k' href='/v?jk=k'>L</a></td>"
    pages = spark.createDataFrame(
        [(1, "https://de.indeed.com/jobs?q=a", linkless * 2 + linked), (2, "https://de.indeed.com/jobs", linked), (3, "https://www.linkedin.com/jobs/", LIST), (4, "https://www.stepstone.de/jobs/x/in-y", "<p data-at='job-item'></p>"),
         (5, "https://example.org", linked), (6, "https://de.indeed.com/", None)], "page_no int, url string, html string",
    )
    assert rows(html.next_pages(pages), "page_no", "n_cards", "has_next") == [(1, 3, False), (2, 1, False), (3, 3, True), (4, 1, False), (5, 0, False), (6, 0, False)]
    assert rows(html.scan_cards(pages), "page_no", "pos", "title") == [(1, 0, "L"), (2, 0, "L"), (3, 0, "Dev Lead"), (3, 1, "Dev Lead")]
    assert html.read_page(html.SITES["indeed"], linkless)[0] == [{"href": None, "id": None, "link_text": None, "title": ["T"], "company": [""], "location": [""]}]

    from gleaner.plans import captures

    monkeypatch.setattr(captures, "_INDEED", f'concat("{linkless}", repeat("{linked}", int(p_partkey % 5)), repeat("{linkless}", 3))')
    parts = spark.range(0, 60, 3).select(F.col("id").alias("p_partkey"), *[F.lit("x").alias(c) for c in ("p_name", "p_brand", "p_type")])
    assert rows(captures.next_page(lambda name: parts), "p_partkey", "n_cards") == [(k, 4 + k % 5) for k in range(0, 60, 3)]


def test_details(spark):
    body = f"<script>no</script><article>{'x' * 301}<br>y</article><div data-at='job-ad-content'>{'s' * 300}</div>"
    pages = spark.createDataFrame([("https://www.stepstone.de/stellenangebote--1", body), ("https://de.indeed.com/viewjob?jk=1", "<div id='jobDescriptionText'> short </div>"), ("https://de.indeed.com/", "")], "url string, html string")
    assert html.scan_details(pages).first()["description"] == "x" * 301 + "\ny"
    assert [r["description"][:3] for r in html.scan_details(pages).collect()] == ["xxx", "sho", ""]


def test_texts_of_lines():
    rng = random.Random(8)
    for _ in range(500):
        raw = "".join(rng.choice([" ", "  ", "\n", "\t", "\r", "\f", "a", "b", "\xa0"]) for _ in range(rng.randrange(25)))
        lines = (re.sub(r"[ \t\r\f]+", " ", x).strip(" ") for x in raw.split("\n"))
        assert html.Node("p", {}, None, [raw]).text() == re.sub(r"\n{3,}", "\n\n", "\n" + "\n".join(lines) + "\n").strip()


def test_large_pages_are_handed_on_in_pieces():
    page = f"<main>{'word ' * 40_000}</main>"
    n, most = 40, 1 << 20
    batch = pa.RecordBatch.from_pydict({"id": list(range(n)), "html": [page] * n, "site": ["stepstone"] * n})
    out = list(html._reader(html.SITES, ("pane", "details"), most)(iter([batch])))
    assert [i for b in out for i in b.column("id").to_pylist()] == list(range(n))
    assert len(out) > 5 and max(b.column("details").nbytes for b in out) <= most + len(page) + 1000
    whole = html.read_page(html.SITES["stepstone"], page)
    assert all(d == whole[2] and p == whole[1] for b in out for d, p in zip(b.column("details").to_pylist(), b.column("pane").to_pylist()))
    small = list(html._reader(html.SITES, html.PARTS, 1)(iter([batch.slice(0, 2), batch.slice(0, 0)])))
    assert [b.num_rows for b in small] == [1, 1]


@pytest.mark.parametrize("given", [None, "64m"])
def test_pages_come_to_the_reader_in_small_batches(spark, monkeypatch, given):
    def reader(sites, parts, most):
        def run(batches):
            for b in batches:  # each row tells the size of the batch that it came in
                n, kept = b.num_rows, [b.column(i) for i, name in enumerate(b.schema.names) if name != "html"]
                found = [pa.array([[]] * n, kind) if pa.types.is_list(kind) else pa.array([str(b.nbytes)] * n) if pa.types.is_string(kind) else pa.array([False] * n) for _, kind in html._FOUND]
                yield pa.RecordBatch.from_arrays([*kept, *found], names=[*[x for x in b.schema.names if x != "html"], *[x for x, _ in html._FOUND]])

        return run

    monkeypatch.setattr(html, "_reader", reader)
    name, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    spark.conf.unset(name) if given is None else spark.conf.set(name, given)
    try:
        pages = spark.range(0, 800, 1, 1).select("id", F.lit("https://www.stepstone.de/").alias("url"), F.expr("repeat('x', 50000)").alias("html"))
        sizes = [int(r["pane"]) for r in html.read_pages(pages).select("pane").collect()]
        assert len(sizes) == 800 and max(sizes) < 10 << 20
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_nodes_of_a_page_go_at_once():
    gc.collect()
    gc.disable()
    try:
        html.read_page(html.SITES["linkedin"], LIST)
        assert not any(isinstance(x, html.Node) for x in gc.get_objects())
    finally:
        gc.enable()


@pytest.mark.parametrize("name", ["scan_cards", "next_page"])
def test_pages_made_of_a_small_file_are_read_by_many_tasks(spark, name):
    from gleaner.plans import captures  # noqa: F401  registers itself
    from gleaner.plans.registry import QUERIES

    plan = QUERIES[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("REPARTITION_BY_NUM")


def test_snapshots_replace_what_they_read(spark, tmp_path):
    s = store.Snapshots(spark, str(tmp_path / "s"), schema.APPLIED)
    assert s.read().count() == 0
    s.replace(spark.createDataFrame([("a", 1)], schema.APPLIED))
    s.replace(s.read().unionByName(spark.createDataFrame([("b", 2)], schema.APPLIED)))
    assert rows(s.read(), "url") == [("a",), ("b",)]
    assert s.reset() == 2 and s.read().isEmpty()


def test_dedupe_comes_before_the_python_reader(spark):
    from gleaner.plans.facade import collect_pages

    pages = spark.createDataFrame([("https://www.linkedin.com/jobs/search/?keywords=dev", LIST, 1)], "url string, html string, page_no int")
    details = spark.createDataFrame([("https://www.linkedin.com/jobs/view/1", "<div id='job-details'>All of it</div>"), ("https://www.linkedin.com/jobs/view/9/", "<div id='job-details'>Other</div>")], "url string, html string")
    got = collect_pages(pages, details)
    assert rows(got, "title", "description") == [("Dev Lead", "All of it")]


def test_postings_are_screened_with_evidence(spark):
    from gleaner.operators import screen

    rows = [
        (1, "Data engineer", "We like data. You must speak German fluently! Python."),
        (2, "Data engineer", "German is a plus.\nFluent German, nice to have. Python, 3 years"),
        (3, "Head of data", "python"),
        (4, "Cook", "Soup."),
        (5, None, None),
        (6, "Python", "10+ years and 2 Jahre. senior"),
    ]
    out = {r["id"]: r for r in screen.screen(spark.createDataFrame(rows, "id int, title string, description string"), {"python": 2.0, "data": 1.0}, 2.0).withColumn("line", screen.audit_line(F.col("id"))).collect()}
    assert [out[i]["verdict"] for i in range(1, 7)] == ["language", "passed", "blocked", "off_profile", "off_profile", "years"]
    assert out[1]["evidence"] == "You must speak German fluently" and out[2]["evidence"] is None
    assert [out[i]["score"] for i in (1, 2, 4, 5, 6)] == [5.0, 4.0, 0.0, 0.0, 4.0]
    assert out[6]["years"] == 10 and out[2]["years"] == 3 and out[5]["years"] is None
    assert out[1]["line"] == "1 | language | You must speak German fluently" and out[2]["line"] == "2 | passed | German is a plus"
    assert out[3]["line"] == "3 | blocked | too_senior" and out[6]["line"] == "6 | years | senior | 10 years" and out[5]["line"] == "5 | off_profile | score under the floor"


def test_running_totals_by_chunks(spark):
    rows = spark.createDataFrame([(k, d, d % 5) for k in "ab" for d in range(40)], "k string, d int, v int")
    plain = run.running_total(rows, "v", "d", ["k"])
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, run.running_total(rows, "v", "d", ["k"], chunk=F.floor(F.col("d") / 7)).select("k", "d", "v", "running").collect()))
