import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
from gleaner.llm import jaccard, packedsteps, prefix_free, repeats, suffix_tree
from gleaner.llm.components import components
from gleaner.llm.store import materialize

KIND = "doc_id bigint, text string"


def corpus(seed, n=60):
    """Families of edited copies, shared passages, repeats, short, empty and null texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(1, 5)))
    passage = " ".join(word() for _ in range(60))
    rows, base = [], []
    for i in range(n):
        if i % 6 == 0:
            base = [word() for _ in range(rng.choice([3, 12, 40, 150]))]
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = word()
        t = rng.choice([" ", "\n", "\t "]).join(w)
        if i % 7 == 0:
            t += " " + passage
        rows.append((i, t))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (None, rows[3][1]), (n + 3, None), (3, rows[3][1]), (None, "only here"), (n + 4, "x " * 300), (n + 5, "a b"), (n + 6, "A  b")]
    return rows


def test_signatures_meet_wherever_sets_are_linked():
    rng = np.random.default_rng(1)
    for percent in (80, 85):
        for _ in range(300):
            n = int(rng.integers(5, 400))
            a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
            b = a.copy()
            for _ in range(int(rng.integers(0, 1 + n // 5))):
                b[rng.integers(0, len(b))] = rng.integers(0, 1 << 60)
            b = np.unique(b)[: int(rng.integers(max(1, n * percent // 100), n + 1))]
            both = len(np.intersect1d(a, b))
            if 100 * both < percent * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            who, sig, need = jaccard.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), jaccard.Bands(percent))
            shared = len(np.intersect1d(sig[who == 0], sig[who == 1]))
            assert shared >= max(1, need[0], need[1])
            assert jaccard.may_link(jaccard._expand(jaccard.compact(a)), jaccard._expand(jaccard.compact(b)), percent)


def tried_of(lists, buckets=4):
    """Pairs (hub, set) that are tried first for (set, signature) lists."""

    def deal(batches):
        of = {}
        for b in batches:
            for kind, k, x, y, z, blob in zip(*[b.column(c).to_pylist() for c in b.schema.names]):
                of.setdefault(k, packedsteps.Bucket()).setdefault(kind, []).append((x, y, z, blob))
        return of.values()

    now = [packedsteps.dealt(jaccard.LISTS, lists, lists[:, 0].copy(), buckets)]
    for work in (jaccard._weigh(buckets), jaccard._hubs(buckets), jaccard._best):
        now = [out for b in deal(now) for out in work(b)]
    return {p for b in now for p in zip(b.column("x").to_pylist(), b.column("y").to_pylist())}


def test_every_set_that_shares_a_signature_is_tried():
    """Set 9 is the hub of all its groups, and each neighbour shares more groups with another hub."""
    lists, sig = [], iter(range(10**6))

    def share(n, *sets):
        for _ in range(n):
            s = next(sig)
            lists.extend((x, s) for x in sets)

    for a, g in ((1, 4), (2, 5), (3, 6)):
        share(10, 9, a)
        share(12, a, g)
        share(11, g, g + 10)
    tried = tried_of(np.array(lists, dtype=np.uint64))
    assert {x for p in tried for x in p} == {x for x, _ in lists}
    assert {(4, 1), (5, 2), (6, 3), (4, 14), (5, 15), (6, 16)} <= tried
    rng = np.random.default_rng(2)
    for _ in range(200):
        sets = [rng.choice(30, int(rng.integers(2, 5)), replace=False) for _ in range(int(rng.integers(5, 60)))]
        lists = np.array([(x, i) for i, group in enumerate(sets) for x in group], dtype=np.uint64)
        assert {x for p in tried_of(lists) for x in p} == set(lists[:, 0].tolist())


@pytest.mark.parametrize("percent,gram", [(85, 4), (80, 5)])
def test_classes_against_all_pairs(spark, percent, gram):
    rows = corpus(percent)
    df = spark.createDataFrame(rows, KIND)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(df, F.col("text"), F.col("doc_id"), percent, gram).collect()), key=repr)
    want = sorted(((d, *x) for (d, _), x in zip(rows, brute.near_classes(rows, percent, gram))), key=repr)
    assert got == want


def test_pairs_of_a_group_come_in_bounded_pieces():
    """10,000 sets of one signature and many roots, in less than 64 MB beside the rows; large groups in blocks, each pair once."""
    import tracemalloc

    rng = np.random.default_rng(3)

    def rooted(n, roots):
        rows = np.zeros((n, 5 + jaccard.WORDS), dtype=np.uint64)
        rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3], rows[:, 4] = 7, np.arange(n), rng.integers(0, roots, n), 1, 60
        rows[:, 5:] = rng.integers(0, 1 << 63, (n, jaccard.WORDS), dtype=np.uint64)
        return rows

    rows = rooted(10_000, 4000)
    rows[500:510, 5:] = rows[0, 5:]
    work = jaccard._across(80, 4)
    tracemalloc.start()
    out = [b for b in work(packedsteps.Bucket({jaccard.ROOTED: [(None, None, None, rows.tobytes())]}))]
    del out
    assert tracemalloc.get_traced_memory()[1] < (64 << 20) + 6 * rows.nbytes
    tracemalloc.stop()

    def pairs_of(large):
        jaccard.LARGE, before = large, jaccard.LARGE
        try:
            of = {}
            for b in jaccard._across(80, 4)(packedsteps.Bucket({jaccard.ROOTED: [(None, None, None, small.tobytes())]})):
                for kind, k, blob in zip(b.column("kind").to_pylist(), b.column("bucket").to_pylist(), b.column("blob").to_pylist()):
                    of.setdefault(k, packedsteps.Bucket()).setdefault(kind, []).append((None, None, None, blob))
            out = [np.frombuffer(x, dtype=np.uint64).reshape(-1, 4) for k in of for b in jaccard._blocks(80, 4)(of[k]) for x in b.column("blob").to_pylist()]
            return sorted(map(tuple, np.concatenate(out).tolist()))
        finally:
            jaccard.LARGE = before

    small = rooted(90, 12)
    small[:, 5:] = small[0, 5:]
    root = small[:, 2]
    want = sorted((i, j, 1, 1) for i in range(90) for j in range(i + 1, 90) if root[i] != root[j])
    assert pairs_of(1000) == want
    assert pairs_of(20) == want


def test_tallies_never_drop_linked_sets():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 3000))
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.3], rng.integers(0, 1 << 60, int(rng.integers(0, 1 + n // 6))).astype(np.uint64)]))
        if len(b) and jaccard._linked(a, b, 80):
            assert jaccard.near_tallies(jaccard._tallied(jaccard.tally(a)), jaccard._tallied(jaccard.tally(b)), 80)
    far = [np.unique(rng.integers(0, 1 << 60, 3000).astype(np.uint64)) for _ in range(2)]
    assert not jaccard.near_tallies(*[jaccard._tallied(jaccard.tally(x)) for x in far], 80)


def test_classes_of_a_large_family(spark, monkeypatch):
    """More sets than a star, a block or a task's group holds."""
    monkeypatch.setattr(jaccard, "STAR", 7)
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    monkeypatch.setattr(jaccard, "LARGE", 9)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(80)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join_documents(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {d: c for (d, _), (_, c) in zip(rows, brute.near_classes(rows, 85, 4))}


def test_one_of_each_group(spark):
    rows = [(5, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (None, "q r s t u v"), (7, ""), (8, None), (8, None), (9, "other text of some words here")]
    out = jaccard.one_of_each(spark.createDataFrame(rows, KIND).withColumn("row", F.lit(1)))
    assert sorted((tuple(r)[:2] for r in out.collect()), key=repr) == sorted([(2, "a b c d e f g"), (None, "q r s t u v"), (7, ""), (8, None), (8, None), (9, "other text of some words here")], key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], KIND)
    assert jaccard.join_documents(none).collect() == []
    assert suffix_tree.dedup_documents(none).collect() == []
    assert prefix_free.dedup_documents(none).collect() == []


def test_batches_of_texts_are_small(spark):
    from gleaner.llm import store

    for given, kept in (("64m", str(store.BATCH_BYTES)), ("1m", "1m")):
        spark.conf.set(store._BATCH, given)
        store.small_batches(spark)
        assert spark.conf.get(store._BATCH) == kept
    spark.conf.unset(store._BATCH)


def test_written_tables_are_released(spark):
    import os

    from gleaner.llm import store

    t = store.materialize(spark.range(5).repartition(2), "thing")
    folder = os.path.dirname(t.inputFiles()[0].removeprefix("file://"))
    assert t.count() == 5 and os.path.isdir(folder)
    store.release(t)
    assert not os.path.exists(folder)


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (9, 8), (8, 7), (5, 5)], "a bigint, b bigint")
    assert sorted(map(tuple, components(links).distinct().collect())) == [(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7), (9, 7)]


def test_a_step_of_components_plans_its_links_four_times_at_most(spark, monkeypatch):
    plans = []

    def recorded(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return materialize(df, name)

    monkeypatch.setattr("gleaner.llm.components.materialize", recorded)
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(20, 21), (20, 20), (20, 21)], "a long, b long")
    assert sorted(map(tuple, components(links).distinct().collect())) == [(i, 1) for i in range(1, 13)] + [(20, 20), (21, 20)]
    assert len(plans) > 2 and max(p.count("Relation ") for p in plans[1:]) == 4


def stretches(seed):
    """Bytes of some stretches, first and windows of each, window length, and by counting whether each window is repeated."""
    rng = np.random.default_rng(seed)
    length = int(rng.integers(3, 60))
    base = rng.integers(97, 97 + int(rng.integers(1, 5)), 400).astype(np.uint8)
    parts, windows = [], []
    for _ in range(int(rng.integers(1, 30))):
        windows.append(int(rng.integers(1, 25)))
        m = windows[-1] + length - 1
        o = int(rng.integers(0, 400 - m))
        x = base[o : o + m].copy() if rng.random() < 0.5 else rng.integers(97, 100, m).astype(np.uint8)
        for _ in range(int(rng.integers(0, 3))):
            x[rng.integers(0, m)] = rng.integers(97, 101)
        parts.append(x)
    size = np.array([len(x) for x in parts])
    first, raw = np.cumsum(size) - size, np.concatenate(parts)
    each = [raw[f + k : f + k + length].tobytes() for f, w in zip(first, windows) for k in range(w)]
    return raw, first, np.array(windows), length, np.array([each.count(x) > 1 for x in each])


def test_both_orders_find_what_counting_finds():
    for seed in range(60):
        raw, first, windows, length, want = stretches(seed)
        assert np.array_equal(suffix_tree.below_deep_nodes(raw.astype(np.uint64), first, windows, length), want)
        assert np.array_equal(prefix_free.repeated(raw, first, windows, length), want)


def test_nodes_of_a_subtree():
    words = np.array([1, 2, 3, 4, 9, 1, 2, 3, 5, 9, 1, 2, 3, 4, 8], dtype=np.uint64)
    places, low, high, depth = suffix_tree.subtree(words, np.array([0, 5, 10]), np.array([3, 3, 3]), 3)
    assert [(sorted(places[a:b].tolist()), d) for a, b, d in zip(low, high, depth)] == [([0, 5, 10], 3), ([1, 11], 3)]


@pytest.mark.parametrize("trigger,modulus", [(1, 2), (3, 5), (8, 64)])
def test_parse_puts_all_suffixes_in_order(trigger, modulus):
    for seed in range(15):
        raw, first, windows, length, _ = stretches(seed)
        size = windows + length - 1
        parse = prefix_free.Parse(raw, first, size, np.arange(len(raw)), trigger, modulus)
        end = np.repeat(first + size, size)
        order = parse.order(np.arange(len(raw)))
        suffixes = [raw[a : end[a]].tobytes() for a in order]
        assert suffixes == sorted(suffixes)
        shared = [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(suffixes, suffixes[1:])]
        assert parse.common(order[:-1], order[1:]).tolist() == shared


@pytest.mark.parametrize("most", [repeats.MOST, 2])
def test_repeated_words_against_a_count_of_windows(spark, most):
    rows = corpus(4)
    df = spark.createDataFrame(rows, KIND).withColumn("row", F.lit("x")).withColumn("n_units", F.lit("clash"))
    out = suffix_tree.remove_repeated_words(df, ["doc_id", "row", "n_units"], most=most)
    assert out.columns == ["doc_id", "row", "n_units", "n_removed", "spans", "kept_sha256", "kept"]
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_units"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in out.collect())
    want = brute.without_repeats([t for _, t in rows], brute.words, lambda w: " ".join(w).encode(), 35)
    assert got == sorted((-1 if d is None else d, *x) for (d, _), x in zip(rows, want))
    assert sum(x[1] for x in want) > 500


@pytest.mark.parametrize("window,most", [(200, repeats.MOST), (400, repeats.MOST), (40, 2)])
def test_repeated_bytes_against_a_count_of_strings(spark, window, most):
    rows = corpus(6) + [(900, "é" * 300), (901, "z" * 1500), (902, "q" + "z" * 450)]
    out = prefix_free.remove_repeated_bytes(spark.createDataFrame(rows, KIND), window=window, most=most)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_units"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in out.collect())
    want = brute.without_repeats([t for _, t in rows], lambda t: list(t.encode()), bytes, window)
    assert got == sorted((-1 if d is None else d, *x) for (d, _), x in zip(rows, want))


def test_a_text_longer_than_a_slice(spark):
    """Over 2 MB, with a passage of another text in its middle and one of its own twice."""
    rng = random.Random(7)
    passage, own = " ".join(f"p{i}" for i in range(120)), " ".join(f"o{i}" for i in range(130))
    filler = lambda: " ".join(f"f{rng.randrange(10**9)}" for _ in range(80_000))
    long = " ".join([filler(), passage, filler(), own, filler(), own])
    assert len(long) > 2 << 20
    df = spark.createDataFrame([(1, long), (2, f"x {passage} y"), (3, "short")], KIND)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in suffix_tree.dedup_documents(df).collect()}
    assert got == {1: (240_380, 380), 2: (122, 120), 3: (1, 0)}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in prefix_free.dedup_documents(df).collect()}
    both = len(passage) + 2 * (len(own) + 1)
    assert got[2][:2] == (len(passage) + 4, len(passage) + 2) or got[2][1] in range(len(passage), len(passage) + 3)
    assert abs(got[1][1] - both) <= 6 and got[1][2] == 3 and got[3] == (5, 0, 0)
    near = spark.createDataFrame([(1, long), (2, long + " more words here"), (3, passage)], KIND)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.join_documents(near).collect()} == {1: 1, 2: 1, 3: 3}


def test_groups_keep_their_bound():
    """Of a prefix with more stretches than `most`, in a task or over all, none goes into a group; the others' verdicts don't change."""
    rng = np.random.default_rng(5)
    anchors = np.stack([rng.integers(0, 20, 3000), rng.integers(0, 40, 3000), rng.integers(0, 500, 3000), rng.integers(0, 9, 3000)], axis=1).astype(np.uint64)
    anchors[:800, 0] = 99
    anchors[:800, 1] = np.arange(800)
    anchors = np.unique(anchors, axis=0)
    anchors[:, 2] = np.arange(len(anchors))
    anchors[:, 1] += anchors[:, 0] * np.uint64(1000)
    stretch = {}
    for p, w, t, k in anchors.tolist():
        stretch.setdefault((p, w), set()).add((t, k))
    prefix = {p: len({w for q, w in stretch if q == p}) for p, _ in stretch}
    for most, tasks in ((100, 1), (100, 7), (30, 3), (5000, 2)):
        dealt, known = [], []
        for part in np.array_split(rng.permutation(anchors), tasks):
            sent, verdicts = repeats.gather(part, most)
            assert np.unique(sent[:, 0], return_counts=True)[1].max() <= most
            dealt.append(sent)
            known.append(verdicts)
        known.append(repeats.judge(np.concatenate(dealt), most))
        got = {}
        for t, x in np.concatenate(known).tolist():
            got[t, x >> 4] = got.get((t, x >> 4), 0) | x & 15
        groups = {}
        for (p, w), places in stretch.items():
            for at in places:
                if len(places) > 1:
                    assert got[at] & repeats.RESOLVED or got[at] == repeats.OPEN | repeats.LONG  # to be counted
                elif prefix[p] > 1:
                    assert got[at] & repeats.OPEN and bool(got[at] & repeats.LONG) == (prefix[p] > most)
            asked = [at for at in places if got.get(at, 0) & (repeats.OPEN | repeats.WITNESS)]
            assert asked or prefix[p] == 1 or not any(len(x) == 1 for (q, _), x in stretch.items() if q == p)
            groups[p] = groups.get(p, 0) + sum(not got[at] & repeats.LONG for at in asked)
        assert max(groups.values()) <= most


def test_kept_text_is_what_is_hashed(spark):
    import hashlib

    rows = [(1, "k " * 40 + "a b"), (2, "c " + "k " * 38)]
    for r in suffix_tree.remove_repeated_words(spark.createDataFrame(rows, KIND)).collect():
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
        assert r["kept"].decode().split() == (["a", "b"] if r["doc_id"] == 1 else ["c"])


def test_words_of_many_texts_at_once():
    from gleaner.llm.units import NOT_BLANK, flat, words

    raw, off = flat(pa.array(["ab c", None, "", "d", "\x0b", "é f"]))
    a, b, at = words(raw, off, NOT_BLANK)
    assert [bytes(raw[x:y]).decode() for x, y in zip(a, b)] == ["ab", "c", "d", "é", "f"]
    assert at.tolist() == [0, 2, 2, 2, 3, 3, 5]
