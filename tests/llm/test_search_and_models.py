import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, fm_index, host_rules, langid, toxicity, url_filter

KIND = "doc_id bigint, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_fm_index_against_a_scan():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 5, 3000)
    x[-1] = 0
    index = fm_index.FMIndex(x, 4)
    phrases = rng.integers(1, 5, (200, 6))
    lengths = rng.integers(1, 7, 200)
    for i, n in enumerate(lengths):
        phrases[i, : 6 - n] = 0
    low, high = index.search(phrases, lengths)
    for p, n, a, b in zip(phrases, lengths, low, high):
        want = [i for i in range(len(x) - n + 1) if (x[i : i + n] == p[6 - n :]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute_hits(docs, items):
    lists = [(k, WORD.findall((t or "").translate(LOW))) for k, t in items]
    windows = {}
    for k, w in lists:
        m = min(10, len(w))
        for i in range(len(w) - m + 1) if m else ():
            windows.setdefault(tuple(w[i : i + m]), set()).add(str(k))
    out = []
    for d, t in docs:
        w, hit, found = WORD.findall((t or "").translate(LOW)), set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit.update(range(i, i + m))
                    found |= windows[tuple(w[i : i + m])]
        out.append((d, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block,shard", [(1 << 25, 1 << 24), (60, 300)])
def test_decontamination_against_a_scan(spark, block, shard):
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "B", "c1", "é", "dd", "x"])
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 9, 10, 25])))) for i in range(8)] + [(8, None), (9, ""), (10, "?!"), (2, "zz yy")]
    docs = []
    for i in range(40):
        t = [word() for _ in range(rng.randrange(0, 40))] + ["unseen"] * (i % 2) + (items[i % 8][1].upper().split() if i % 3 == 0 else [])
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(t)))
    docs += [(50, None), (51, ""), (None, items[1][1]), (3, docs[3][1])]
    out = decontaminate.decontaminate(
        spark.createDataFrame(docs, KIND).withColumn("spare", F.lit(1)), spark.createDataFrame(items, "item_id bigint, text string"), ["doc_id", "spare"], cut=True, block_bytes=block, shard_bytes=shard
    )
    rows = out.collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"])) for r in rows), key=repr)
    assert got == sorted(brute_hits(docs, items), key=repr)
    for r in rows:
        assert r["n_hit"] == sum(s["end"] - s["start"] for s in r["spans"])
        left = WORD.findall((r["clean_text"] or "").translate(LOW))
        assert r["n_hit"] == 0 or len(left) <= r["n_words"] - r["n_hit"]
    same = {d: t for d, t in docs if d not in (None, 3)}
    assert all(r["clean_text"] == same[r["doc_id"]] for r in rows if not r["n_hit"] and r["doc_id"] in same)


def test_the_driver_holds_one_block_of_the_benchmark(spark, monkeypatch):
    import weakref

    alive, sizes, most = weakref.WeakSet(), [], []

    class Held(decontaminate.Phrases):
        def __init__(self, ids, texts, window):
            sizes.append((len(texts), sum(8 + len((t or "").encode()) for t in texts)))
            super().__init__(ids, texts, window)
            alive.add(self)
            most.append(len(alive))

    monkeypatch.setattr(decontaminate, "Phrases", Held)
    items = [(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(300)]
    docs = [(i, f"before {items[i * 7][1]} after") for i in range(40)]
    out = decontaminate.decontaminate(spark.createDataFrame(docs, KIND), spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=3000)
    assert sorted((r["doc_id"], r["n_hit"], r["items"]) for r in out.collect()) == [(i, 12, [str(i * 7)]) for i in range(40)]
    assert len(sizes) > 5 and sum(n for n, _ in sizes) == 300 and all(b <= 3000 for _, b in sizes)
    assert max(most) <= 2  # a block, and what is not yet collected of the one before


def test_decontamination_of_and_with_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], KIND), spark.createDataFrame([], "item_id bigint, text string")
    assert [tuple(r) for r in decontaminate.check_documents(docs, items).select("doc_id", "n_words", "n_hit", "contaminated").collect()] == [(1, 2, 0, False)]
    assert decontaminate.check_documents(docs.limit(0), docs.select(F.col("doc_id").alias("item_id"), "text")).collect() == []


def test_forward_backward_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(3)
    score, move = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    post, pairs, logz = langid.forward_backward(score, np.array([4]), move)
    weight = {p: np.exp(sum(score[0, t, s] for t, s in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))) for p in product(range(3), repeat=4)}
    z = sum(weight.values())
    want = np.zeros((4, 3))
    moves = np.zeros((3, 3))
    for p, w in weight.items():
        for t, s in enumerate(p):
            want[t, s] += w / z
        for a, b in zip(p, p[1:]):
            moves[a, b] += w / z
    assert np.allclose(post[0], want) and np.allclose(pairs, moves) and np.isclose(logz[0], np.log(z))


def test_windows_hand_on_their_messages():
    rng = np.random.default_rng(6)
    move, t = rng.normal(size=(3, 3)), 4
    sizes = [1, 4, 5, 11, 12, 3]
    windows = np.array([-(-n // t) for n in sizes])
    score, length = np.zeros((windows.sum(), t, 3)), np.zeros(windows.sum(), dtype=int)
    want, at = [], 0
    for n, w in zip(sizes, windows):
        one = rng.normal(size=(n, 3)) * 2
        want.append(langid.forward_backward(one[None], np.array([n]), move)[0][0])
        for k in range(w):
            part = one[k * t : (k + 1) * t]
            score[at + k, : len(part)], length[at + k] = part, len(part)
        at += w
    post, _, _ = langid.forward_backward(score, length, move, *langid.between(score, length, move, windows))
    got = np.concatenate([p[:n] for p, n in zip(post, length)])
    assert np.allclose(got, np.concatenate(want))


def texts(seed, n):
    rng = random.Random(seed)
    kinds = {"aa": ["the", "and", "with", "there", "thing", "going"], "bb": ["der", "und", "nicht", "schön", "über", "machen"]}
    return [(i, " ".join(rng.choices(kinds[k], k=rng.randrange(5, 60))), k) for i, k in enumerate(rng.choices(list(kinds), k=n))]


def test_languages(spark):
    rows = texts(1, 120)
    extra = [(500, None, "aa"), (501, "", "bb"), (502, "12 ?! …", "aa"), (503, "the and with there " * 20 + "und nicht über " * 20, None), (None, "und der nicht", None), (504, "the going", None)]
    df = spark.createDataFrame(rows + extra, "doc_id bigint, text string, lang string").withColumn("size", F.lit(0))
    out = {r["doc_id"]: r for r in langid.identify(df, ~langid.held_out(), ["doc_id", "size"]).collect()}
    held = [(i, k) for i, _, k in rows if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 20 and sum(out[i]["lang_pred"] == k for i, k in held) >= 0.9 * len(held)
    assert all((out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0) for i in (500, 501, 502))
    assert [x["lang"] for x in out[503]["runs"]] == ["aa", "bb"] and [x["words"] for x in out[503]["runs"]] == [80, 60]
    assert out[None]["lang_pred"] == "bb" and out[504]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in out.values())
    unlabelled = langid.identify_documents(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"} and langid.identify_documents(df.limit(0)).collect() == []


def test_middles_of_long_words_count(spark):
    """Runs without blanks that begin and end alike and differ only between."""
    rng = random.Random(5)
    kinds = {"ja": "のはをにがでとも", "zh": "的是不了在有我他"}
    text = lambda k: "漢" * 4 + "".join(rng.choices(kinds[k], k=40)) + "漢" * 4
    rows = [(i, text(k), k) for i, k in enumerate(["ja", "zh"] * 100)]
    out = {r["doc_id"]: r["lang_pred"] for r in langid.identify_documents(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    held = [(i, k) for i, _, k in rows if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 20 and sum(out[i] == k for i, k in held) >= 0.9 * len(held)


def test_toxicity_finds_documents_and_sentences(spark):
    rng = random.Random(2)
    plain = ["one", "two", "three", "four", "five", "six"]
    sentence = lambda *more: " ".join(rng.sample(plain, 4) + list(more)) + "."
    rows, marks = [], []
    for i in range(600):
        bad = i % 3 == 0
        parts = [sentence() for _ in range(rng.randrange(1, 12))] + ([sentence("vile")] if bad else [])
        rng.shuffle(parts)
        rows.append((i, " ".join(parts)))
        marks.append((i, int(bad)))
    extra = [(900, None), (901, ""), (902, "vile"), (None, "one two vile. three four")]
    labels = spark.createDataFrame(marks + [(900, None), (None, 1), (77777, 1)], "doc_id bigint, toxic int")
    df = spark.createDataFrame(rows + extra, KIND)
    out = {r["doc_id"]: r for r in toxicity.score_documents(df, labels, ~toxicity.held_out()).collect()}
    wrong = sum((out[i]["score"] >= 0.5) != bool(t) for i, t in marks)
    assert wrong <= 0.02 * len(marks)
    assert out[900]["score"] == out[901]["score"] == 0 and out[902]["score"] > 0.5
    spans = [rows[0][1].encode()[s["start"] : s["end"]].decode() for s in out[0]["offending"]]
    assert len(spans) == 1 and "vile" in spans[0]
    assert toxicity.toxicity_documents(df.limit(0), labels).collect() == []
    assert {r["score"] < 0.5 for r in toxicity.toxicity_documents(df, labels.limit(0)).collect()} == {True}


def test_noisy_or_slopes_against_differences():
    rng = np.random.default_rng(7)
    bag = np.sort(rng.integers(0, 6, 20))
    bag[-1] = 5
    z, y, count = rng.normal(size=20), np.array([0, 1, 1, 0, 1, 0.0]), rng.random(6)

    def likelihood(z):
        total = 0.0
        for d in range(6):
            none = np.prod([1 - 1 / (1 + np.exp(-x)) for x in z[bag == d]])
            total += count[d] * np.log(1 - none if y[d] else none) if (bag == d).any() else 0
        return total

    got = toxicity.slopes(z, bag, y, count)
    for i in range(20):
        step = np.eye(20)[i] * 1e-6
        assert abs(got[i] - (likelihood(z + step) - likelihood(z - step)) / 2e-6) < 1e-6


def test_copies_do_not_fill_the_samples(spark, monkeypatch):
    took = []
    monkeypatch.setattr(langid.Field, "train", lambda self, texts, labels: took.extend((t, self.languages[i]) for t, i in zip(texts, labels)))
    rows = [("same text", "aa")] * 3000 + [(f"text {i}", "aa") for i in range(60)] + [(f"other {i}", "bb") for i in range(300)]
    langid.learn(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", F.lit(True), 20)
    assert len(set(took)) == len(took)
    assert all(8 <= sum(k == lang for _, k in took) <= 40 for lang in ("aa", "bb"))

    took.clear()
    monkeypatch.setattr(toxicity.Model, "train", lambda self, texts, labels, weight: took.extend(zip(texts, labels)))
    docs = spark.createDataFrame([(i, f"text {i} {j}") for i in range(20) for j in range(100)] + [(i, f"text {i} 0") for i in range(20)], KIND)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] * 50, "doc_id bigint, toxic int")
    toxicity.learn(docs, labels, F.lit(True), (5, 5))
    assert len(took) == len(set(took)) == 20 and len({t.split()[1] for t, _ in took}) == 10


def test_urls_against_plain_arithmetic(spark):
    urls = ["http://Win.Casino.example.net/poker?x=1", "https://docs.example.com/fr/a", "http://example.org/es/x", "http://a.example.org/en/12", "http://badexample.org/es/", "http://x.com/de/1#y", "http://x.org", None, "", "no url",
            "://", "a://b://c/d", "http://h/" + "p" * 5000]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string").withColumn("rule", F.lit("old"))
    labelled = url_filter.default_labels(spark)
    rows = url_filter.labelled_urls()
    assert len(dict(rows)) > 1100 and rows == url_filter.labelled_urls() and 0.2 < sum(t for _, t in rows) / len(rows) < 0.3
    out = [r for r in url_filter.filter_urls(pages, labelled).orderBy("page_id").collect()]
    assert [(r["host"], r["path"]) for r in out[:7]] == [("win.casino.example.net", "/poker"), ("docs.example.com", "/fr/a"), ("example.org", "/es/x"), ("a.example.org", "/en/12"), ("badexample.org", "/es/"), ("x.com", "/de/1"), ("x.org", "")]
    assert [(r["host"], r["path"]) for r in out[7:12]] == [("", ""), ("", ""), ("", ""), ("", ""), ("b:", "//c/d")]
    assert [r["rule"] for r in out[:7]] == [None, "com/fr/", "example.org/es/", "example.org/en/1", "org/", "com/de/", None]
    assert [r["verdict"] for r in out[:6]] == ["block", "allow", "block", "block", "allow", "block"]
    # The same descent in numpy, on the features that Spark gives.
    every = labelled
    labelled = every.filter(url_filter.split_of(F.col("url")) > 1)
    feats = [(r["label"], r["__f"]) for r in url_filter.with_features(labelled.select("label", *[c.alias(n) for c, n in zip(url_filter.url_parts(F.col("url")), ("h", "p"))]), "h", "p").collect()]
    x = np.zeros((len(feats), url_filter.DIM))
    for i, (_, f) in enumerate(feats):
        x[i, f] = 1 / np.sqrt(len(f))
    y, w, b = np.array([t for t, _ in feats], dtype=float), np.zeros(url_filter.DIM), 0.0
    q, q_b = np.zeros(url_filter.DIM), 0.0
    for _ in range(url_filter.EPOCHS):
        wrong = y - 1 / (1 + np.exp(-(b + x @ w)))
        g, g_b = x.T @ wrong / len(y) - url_filter.DECAY * w, wrong.mean()
        q, q_b = q + g * g, q_b + g_b * g_b
        w, b = w + url_filter.RATE * g / np.sqrt(q + 1e-12), b + url_filter.RATE * g_b / np.sqrt(q_b + 1e-12)
    got = url_filter.train(labelled)
    assert np.allclose(got[:-1], w) and np.isclose(got[-1], b)
    right = sum((s >= 0.5) == bool(t) for s, t in zip(1 / (1 + np.exp(-(b + x @ w))), y))
    assert right >= 0.95 * len(y)
    # What the model never saw.
    fresh = every.filter(url_filter.split_of(F.col("url")) == 1)
    seen = url_filter.filter_urls(fresh, every, rules=[]).select("label", "verdict").collect()
    blocked = [r["label"] for r in seen if r["verdict"] == "block"]
    assert len(seen) > 200 and sum((r["verdict"] == "block") == (r["label"] == 1) for r in seen) >= 0.93 * len(seen)
    assert sum(blocked) >= 0.97 * len(blocked) and sum(blocked) >= 0.85 * sum(r["label"] for r in seen)
    assert url_filter.filter_urls(pages.limit(0), every).collect() == []
    assert {r["score"] for r in url_filter.filter_urls(pages, every.limit(0)).collect()} == {0.5}


def test_host_rules_against_plain_code(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        w = [rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.choice([0, 5, 30, 60]))]
        if i % 4 == 0:
            w += w[:12]
        t = " ".join(w)
        if i % 5 == 0:
            t = "\n".join([t[:20], t[:20], " ", " ", "#x", t, "#x"])
        rows.append((i, t, f"h{i % 3}"))
    rows += [(200, None, None), (201, "", None), (202, "a\n\nb", "h1"), (203, "x y " * 500, "h9"), (204, "#" * 40, "bad")] + [(300 + i, "too short", "bad") for i in range(50)]
    out = {r["doc_id"]: r for r in host_rules.apply_host_rules(spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("n_words", F.lit("clash"))).collect()}
    for i, t, h in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        covered = set()
        for k, g in enumerate(grams):
            if grams.count(g) > 1:
                covered.update(range(k, k + 8))
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert not any(out[i]["host_ok"] for i in (204, 310)) and out[0]["host_ok"]
    assert host_rules.quality_documents(spark.createDataFrame([], "doc_id bigint, text string, source string")).collect() == []


def test_texts_longer_than_a_slice(spark):
    """Over 2 MB each, with what is looked for behind the first megabyte."""
    from gleaner.llm import mixing, sharding

    rng = random.Random(11)
    fill = lambda words, n: " ".join(rng.choices(words, k=n))
    plain = ["one", "two", "three", "four", "five", "six", "seventeen"]
    item = " ".join(f"q{i}" for i in range(12))
    long = f"{fill(plain, 300_000)}. {item}. vile. {fill(plain, 200_000)}"
    assert len(long) > 2 << 20
    short = [(i, fill(plain, 30) + (". vile." if i % 2 else "."), "en", "s") for i in range(60)] + [(100 + i, fill(["der", "und", "nicht", "machen"], 30), "de", "t") for i in range(60)]
    df = spark.createDataFrame([*short, (500, long, None, "s")], "doc_id bigint, text string, lang string, source string")
    one = lambda out: out.filter("doc_id = 500").first().asDict()
    n = len(WORD.findall(long))
    got = one(decontaminate.check_documents(df, spark.createDataFrame([(7, item)], "item_id bigint, text string")))
    assert (got["n_words"], got["n_hit"], got["n_items"]) == (n, 12, 1)
    assert one(langid.identify_documents(df))["lang_pred"] == "en"
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(100 + i, 0) for i in range(60)], "doc_id bigint, toxic int")
    got = one(toxicity.score_documents(df, labels, F.lit(True)))
    assert [long[s["start"] : s["end"]].strip() for s in got["offending"]] == ["vile."]
    got = one(host_rules.quality_documents(df))
    assert got["n_words"] == len(long.split()) and not got["base_failed"] == (100 * got["n_repeat_words"] <= 30 * got["n_words"])
    assert one(mixing.mix_documents(df))["size"] == len(long.split())
    assert one(sharding.shard_documents(df))["size"] == len(long) + 1
