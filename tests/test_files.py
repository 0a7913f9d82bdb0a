import datetime as dt
import re

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNull, LessThan, StringContains

from gleaner.sources import pagestore, pdfs


def some_pages(spark):
    rows = [(f"http://{i}", f"<p>{'é' * (i % 4)}\n{i}" if i % 6 else None, dt.date(2024, 5, 1 + i % 4) if i % 5 else None, f"s {i % 3}/x" if i % 7 else None) for i in range(60)]
    return rows, spark.createDataFrame(rows, "url string, html string, day date, site string")


def test_only_the_files_a_filter_leaves_are_read(spark, tmp_path):
    rows, df = some_pages(spark)
    folder = str(tmp_path / "store")
    pagestore.save(df.repartition(3), folder)
    every = pagestore.listed(folder)
    assert {(f.day, f.site) for f in every} == {r[2:] for r in rows}
    day = dt.date(2024, 5, 2)
    reader = pagestore.PageReader(folder)
    left = list(reader.pushFilters([EqualTo(("day",), day), In(("site",), ("s 0/x", "s 1/x")), StringContains(("html",), "1"), LessThan(("url",), "x")]))
    assert [type(f) for f in left] == [StringContains, LessThan]
    read = [f for p in reader.partitions() for f in p.files]
    assert read == [f for f in every if f.day == day and f.site in ("s 0/x", "s 1/x")] and 0 < len(read) < len(every)
    got = pagestore.load(spark, folder)
    found = got.filter((F.col("day") == F.lit(day)) & F.col("site").isin("s 0/x", "s 1/x") & F.col("html").contains("1"))
    assert sorted(tuple(r) for r in found.collect()) == sorted(r for r in rows if r[2] == day and r[3] in ("s 0/x", "s 1/x") and r[1] and "1" in r[1])
    plan = found._jdf.queryExecution().executedPlan().toString()
    kept = re.search(r"Filter \((.*)", plan)
    assert kept is None or "day" not in kept[1]  # the source has taken it
    assert sorted(map(tuple, pagestore.load(spark, folder).collect()), key=repr) == sorted(rows, key=repr)
    none = pagestore.PageReader(folder)
    assert not list(none.pushFilters([IsNull(("day",))])) and {f.day for p in none.partitions() for f in p.files} == {None}
    assert spark.conf.get("spark.sql.python.filterPushdown.enabled") == "false"


def test_odd_lines_large_files_and_an_empty_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pagestore, "LINES", 7)
    folder = tmp_path / "day=2024-05-01" / "site=a"
    folder.mkdir(parents=True)
    (folder / "x.json").write_text('{"url": "u", "html": 5}\n\nno\n[1]\n' + '{"url": "v", "html": "' + "y" * 3_000_000 + '"}\n' + '{"html": "end"}\n' * 20)
    (folder / "_SUCCESS").write_text("x")
    (tmp_path / "day=2024-05-02" / "site=b").mkdir(parents=True)
    got = pagestore.load(spark, str(tmp_path)).collect()
    assert [(r["url"], r["html"] and len(r["html"])) for r in got] == [("u", None), (None, None), (None, None), ("v", 3_000_000)] + [(None, 3)] * 20
    assert pagestore.load(spark, str(tmp_path / "day=2024-05-02")).count() == 0


def test_small_files_share_a_partition(tmp_path, monkeypatch):
    monkeypatch.setattr(pagestore, "PART_BYTES", 25)
    for i in range(6):
        d = tmp_path / "day=2024-05-01" / f"site={i}"
        d.mkdir(parents=True)
        (d / "x.json").write_text("{}" * 5)
    assert [len(p.files) for p in pagestore.PageReader(str(tmp_path)).partitions()] == [2, 2, 2]


def test_files_truncated_padded_and_broken_are_told_apart(spark, tmp_path):
    good = pdfs.document(["a (b) \\ c", "", "ü€"] + ["x"] * 120)
    xref = good.rindex(b"xref\n0")
    start = good.rindex(b"startxref")
    second = good[:xref] + good[xref:].replace(b"/Root 1 0 R", b"/Root 1 0 R /Prev 9")
    inside = good[:start] + b"%" + b"X" * 4000 + b"\n" + good[start:]
    table = [
        ("good", good, None, 3), ("one", pdfs.document([]), None, 1), ("cut", good[:-40], "no pointer near the end", None), ("half", good[: len(good) // 2], "no pointer near the end", None),
        ("inside", inside, None, 3), ("behind", good + b"X" * 2000, "no pointer near the end", None), ("near", good + b"\n" * 900, None, 3), ("head", good[1:], "no header", None), ("empty", b"", "no header", None), ("null", None, "no header", None),
        ("moved", good.replace(b"4 0 obj", b" 4 0 obj", 1), None, None), ("prev", second, "no table where the pointer points", None), ("entry", good[:xref] + good[xref:].replace(b"00000 n \n", b"00000 q \n", 1), "a broken table", None),
        ("count", good.replace(b"/Count 3", b"/Count 4"), "another number of pages than the tree says", None), ("root", good.replace(b"/Root 1", b"/Toor 1"), "no catalog", None), ("circle", good.replace(b"/Kids [4 0 R 6 0 R", b"/Kids [2 0 R 2 0 R"), "pages go round in a circle", None),
    ]
    df = spark.createDataFrame([(n, c) for n, c, *_ in table], "name string, content binary")
    got = {r["name"]: r for r in pdfs.verified(df, "name").collect()}
    for name, content, problem, pages in table:
        r = got[name]
        assert r["bytes"] == len(content or b"") and r["above_floor"] == (r["bytes"] >= 8192)
        if name == "moved":
            assert not r["opens"]
        else:
            assert (r["opens"], r["problem"], r["pages"]) == (problem is None, problem, pages), name
    padded = df.filter("name IN ('good', 'one', 'cut', 'null')").withColumn("content", pdfs.pad(F.col("content")))
    seen = {r["name"]: (r["opens"], r["pages"], r["bytes"]) for r in pdfs.verified(padded, "name").collect()}
    assert seen["one"] == (True, 1, 8258) and seen["good"][:2] == (True, 3) and seen["good"][2] == 8258 and not seen["cut"][0] and seen["null"] == (False, None, 0)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.pdf").write_bytes(good)
    (tmp_path / "y.txt").write_bytes(good)
    (row,) = pdfs.verified(pdfs.read(spark, str(tmp_path)).withColumnRenamed("path", "name"), "name").collect()
    assert row["opens"] and row["pages"] == 3 and row["name"].endswith("sub/x.pdf")


def test_drawn_files_hold_their_lines(spark):
    df = spark.createDataFrame([("a", ["one", None, "(two)"]), ("b", None), ("c", ["x" * 100_000] * 101)], "name string, lines array<string>")
    got = {r["name"]: bytes(r["content"]) for r in pdfs.drawn(df, "name", F.col("lines")).collect()}
    assert b"(one) Tj" in got["a"] and b"(\\(two\\)) Tj" in got["a"]
    assert [pdfs._verified(got[k]) for k in "abc"] == [(None, 1), (None, 1), (None, 3)]
    assert pdfs.drawn(df.limit(0), "name", F.col("lines")).count() == 0
