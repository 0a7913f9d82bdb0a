import json

from pyspark.sql import functions as F

from gleaner.plans.facade import Service, gate_command
from gleaner.sources import schema
from gleaner.streaming import ingest, runs


def page(folder, n, rows):
    (folder / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))


def sighting(url, seq, title="t", description=""):
    return {"title": title, "company": "c", "location": "", "url": url, "source": "s", "query": "q", "description": description, "seq": seq, "page_no": 1, "pos": 0}


def test_stream_of_pages_into_store(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    page(inbox, 1, [sighting("http://x/1", 1, description="long"), sighting("http://x/2", 2)])
    store = ingest.postings_store(spark, str(tmp_path / "store"))
    for n, rows in ((2, [sighting("http://x/1?a=1", 3, "new title")]), (3, [sighting("http://x/1", 1, description="long")])):
        ingest.ingest(ingest.read_sightings(spark, str(inbox), 1), store, str(tmp_path / "cp"), once=True).awaitTermination()
        page(inbox, n, rows)
    ingest.ingest(ingest.read_sightings(spark, str(inbox), 1), store, str(tmp_path / "cp"), once=True).awaitTermination()
    got = sorted((r["key"], r["title"], r["description"], r["first_seq"]) for r in store.read().collect())
    assert got == [("http://x/1", "new title", "long", 1), ("http://x/2", "t", "", 2)]


def test_runs_are_kept_in_the_checkpoint(spark, tmp_path):
    kind = "run_id string, seq bigint, kind string, total int, added int, has_next boolean, at_ms bigint"
    inbox = tmp_path / "ev"
    inbox.mkdir()
    out = str(tmp_path / "out")

    def put(n, *events):
        page(inbox, n, [dict(zip(("run_id", "seq", "kind", "total", "added", "has_next", "at_ms"), e)) for e in events])
        stream = spark.readStream.schema(kind).json(str(inbox))
        runs.follow(stream).writeStream.format("json").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    put(1, ("a", 1, "start", 3, 0, True, 1000), ("a", 2, "page", 0, 5, True, 2000), ("b", 3, "start", 9, 0, True, 1000))
    put(2, ("a", 4, "start", 2, 0, True, 3000), ("a", 5, "page", 0, 2, False, 4000), ("b", 6, "page", 0, 1, True, 1000 + 20 * 60 * 1000 + 1), ("a", 7, "page", 0, 9, True, 5000))
    got = sorted((r["run_id"], r["status"], r["page_no"], r["collected"]) for r in spark.read.schema(runs.OUT).json(out).collect())
    assert got == [("a", "done", 2, 7), ("a", "page", 1, 5), ("a", "refused", 0, 5), ("a", "started", 0, 0), ("b", "expired", 0, 0), ("b", "started", 0, 0)]
    # A run that is left alone ends when the others' events have gone on for long enough.
    put(3, ("c", 8, "start", 5, 0, True, 2_000_000))
    put(4, ("d", 9, "start", 5, 0, True, 9_000_000))
    put(5, ("e", 10, "start", 5, 0, True, 9_000_001))
    after = [r["run_id"] for r in spark.read.schema(runs.OUT).json(out).filter("status = 'expired'").collect()]
    assert sorted(after) == ["b", "c"]


def test_service(spark, tmp_path):
    s = Service(spark, str(tmp_path))
    rows = spark.createDataFrame([tuple(sighting(f"http://x/{i}", i).values()) for i in (1, 2, 2)], schema.SIGHTING)
    assert s.push(rows) == {"ok": True, "added": 2, "total": 2, "with_description": 0}
    assert s.push(rows.limit(0)) == {"ok": True, "added": 0}
    urls = spark.createDataFrame([("http://x/1", 1)], "url string, seq bigint")
    assert s.applied(urls) == {"ok": True, "added": 1, "total": 1, "matches": 1}
    assert s.applied(urls)["added"] == 0
    assert s.status().first()["applied"] == 1
    (tmp_path / "reports").mkdir()
    for day in ("2024-01-02.html", "2024-01-10.html"):
        (tmp_path / "reports" / day).write_text("x")
    now = s.status(day_begins=2).first()
    assert (now["collected_today"], now["latest_report"], now["last_rank"]["matches"]) == (1, "2024-01-10.html", 1)
    assert s.last_push.read().first().asDict() == {"seq": 2, "sent": 3, "added": 2}
    for kw in ("one", "two"):
        s.save_search(spark.createDataFrame([(kw, "", 5, "indeed", 7, None)], schema.SAVED_SEARCH))
    assert [r["kw"] for r in s.searches.read().collect()] == ["two"]
    assert s.reset()["archived"] == 2 and s.postings.read().isEmpty() and s.applied_list.read().count() == 1


def test_a_batch_rewrites_the_parts_it_touches(spark, tmp_path):
    store = ingest.postings_store(spark, str(tmp_path / "s"), 8)
    send = lambda *rows: ingest.ingest_batch(store, spark.createDataFrame([tuple(sighting(*r).values()) for r in rows], schema.SIGHTING))
    send(*[(f"http://x/{i}", i) for i in range(40)])
    _, before = store._current()
    send(("http://x/7?a", 100, "new"), ("", 101))
    _, after = store._current()
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    got = {r["key"]: (r["title"], r["seq"], r["first_seq"]) for r in store.read().collect()}
    assert len(got) == 40 and got["http://x/7"] == ("new", 100, 7) and got["http://x/8"] == ("t", 8, 8)
    send(("", 102))
    assert store.read().count() == 40


def test_gate_command(spark, tmp_path):
    assert gate_command(spark, [])[0] == 2
    code, found = gate_command(spark, [str(tmp_path / "absent.json")])
    assert code == 1 and found.select(F.col("rule")).first()[0] == "not_found"
