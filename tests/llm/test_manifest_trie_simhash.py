import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gleaner.llm import merkle, simhash, trie
from gleaner.llm.ordering import numbered

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, pos long, tree string, `a.b` int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def some_docs(n, seed=5, sources=("a", "b", None, "ä", "")):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice(["Ab", "cd", "Ef é", "x\ny"]) for _ in range(r.randint(0, 6))) if i % 7 else None, "de" if i % 3 else None, r.choices(sources, [60, 5, 3, 2, 1])[0], i if i % 5 else None, 1, "t", 2) for i in range(-3, n)]
    r.shuffle(rows)
    return [*rows, rows[0], rows[0], (None, "No Id", None, "a", 1, 1, "t", 2), (None, "no", None, "solo", 1, 1, "t", 2)]


def brute_merkle(rows):
    def cell(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return H(*[cell(v) for v in (r[0], r[3], r[2], r[4], text)])

    def tree(hashes):
        """(root, ways): a way is a list of (run, slot)."""
        ways, now, at = [[] for _ in hashes], hashes, list(range(len(hashes)))
        while len(now) > 1:
            runs = [now[i : i + 16] for i in range(0, len(now), 16)]
            for w, a in zip(ways, at):
                w.append((runs[a // 16], a % 16))
            now, at = [H(*x) for x in runs], [a // 16 for a in at]
        return (now or [None])[0], ways

    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    root, over = tree([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, over):
        for (_, _, h, r), way in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1]):
            beside, back = "", h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                back = leaf(r, r[1].translate(LOW))
            for run, slot in [*way, *up]:
                beside += "".join(run[:slot] + run[slot + 1 :])
                back = H(*run[:slot], back, *run[slot + 1 :])
            out.append((r[0], h, trees[s][0], root, H(beside), back, back == root))
    return out


@pytest.mark.parametrize("n", [0, 1, 17, 300])
def test_merkle_manifest_by_hand(spark, n):
    rows = some_docs(n) if n else []
    got = merkle.check_documents(spark.createDataFrame(rows, DOC))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_merkle(rows), key=repr)


def test_merkle_one_source_and_one_row(spark):
    rows = [(7, "Long " * 500_000, "de", "a", 1, 1, "t", 2)]
    (got,) = merkle.check_documents(spark.createDataFrame(rows, DOC)).collect()
    assert tuple(got) == brute_merkle(rows)[0] and got["leaf"] == got["root"] and got["proof_sha256"] == H("")


def test_merkle_a_row_repeated_very_often(spark):
    one = spark.createDataFrame([(1, "Ab", "de", "a", 2, 1, "t", 2)], DOC)
    rows = one.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20_000)))).drop("k")
    got = merkle.check_documents(rows)
    assert got.count() == 20_000 and got.filter("verified").count() == 20_000 and got.select("root").distinct().count() == 1
    runs = numbered(rows.select("source", "doc_id"), "source", [F.col("doc_id").asc()], "t")
    assert sorted(r["pos"] for r in runs.collect()) == list(range(20_000))


TURN = "conv_id long, turn int, role string, text string, depth int, k1 string"


def brute_trie(rows):
    by = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            by.setdefault(c, []).append((t is not None, t or 0, bytes.fromhex(H(f"{len(role.encode())}:", role, text)), (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in by.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + own[c][h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def sums(p):
        stack, leaves, saved = [p], 0, 0
        while stack:
            q = stack.pop()
            leaves += q not in kids
            saved += (len(nodes[q]) - 1) * (len(WORD.findall(q[-1][1])) if q else 0)
            stack += kids.get(q, [])
        return leaves, saved

    out = []
    for p, members in nodes.items():
        ends = sorted(c for c in members if len(built[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, [])), *sums(p), H(",".join(map(str, ends)))))
    return out


def some_turns(seed, convs=60):
    r = random.Random(seed)
    rows = []
    for c in range(-25, convs):
        if c % 9 == 4:
            continue
        for t in range(r.randint(1, 5)):
            rows.append((c, t if t or c % 4 else None, r.choice(["user", None, "bot"]), r.choice(["a b", "c", "", None]), 0, "x"))
    deep = [(t, "user", f"w{t} x") for t in range(45)]
    for c, keep in ((1000, 45), (1001, 45), (1002, 30), (1003, 9), (1004, 8), (1010, 40)):
        rows += [(c, *x, 0, "x") for x in deep[:keep]]
    return [*rows, rows[3], rows[3], (None, 0, "user", "nobody", 0, "x"), (5, 2, "user", "tie", 0, "x"), (5, 2, "bot", "tie", 0, "x")]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_by_hand(spark, seed):
    rows = some_turns(seed)
    random.Random(seed).shuffle(rows)
    got = trie.conversation_trie(spark.createDataFrame(rows, TURN))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_trie(rows), key=repr)


def test_trie_of_nothing_of_one_and_of_copies(spark):
    assert trie.conversation_trie(spark.createDataFrame([], TURN)).count() == 0
    for rows in ([(40, 1, "user", "a b c", 0, "x")], [(41, 1, "user", "a", 0, "x")], [(c, t, "user", "long " * (100_000 if c == 100 else 1), 0, "x") for c in range(100, 130) for t in range(3)]):
        got = trie.conversation_trie(spark.createDataFrame(rows, TURN))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_trie(rows), key=repr)


def test_chain_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    rows = some_turns(3, 10)
    got = trie.conversation_trie(spark.createDataFrame(rows, TURN))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_trie(rows), key=repr)


def brute_print(text):
    words = [zlib.crc32(w.encode()) for w in WORD.findall(text.translate(LOW))]
    runs = [words[i : i + 5] for i in range(max(1, len(words) - 4))] if words else []
    votes, total = [0] * 128, 0

    def mix(x, seed):
        x ^= seed
        for _ in range(2):
            x = ((x >> 16 ^ x) * 0x45D9F3B) & 0xFFFFFFFF
        return x >> 16 ^ x

    def run(ws):
        h = 2166136261
        for w in ws:
            h = ((h ^ w) * 16777619) & 0xFFFFFFFF
        return h

    for base, weight in [*((w, 1) for w in set(words)), *((run(x), 2) for x in runs)]:
        total += weight
        for k, seed in enumerate((0x243F6A88, 0x85A308D3, 0x13198A2E, 0x03707344)):
            h = mix(base, seed)
            for b in range(32):
                votes[32 * k + b] += weight * (h >> b & 1)
    return sum(1 << b for b in range(128) if 2 * votes[b] > total)


def hexed(x):
    return "".join(f"{x >> 32 * k & 0xFFFFFFFF:08x}" for k in range(4))


def brute_simhash(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    texts = [r[1] or "" for r in rows]
    prints = [brute_print(t) for t in texts]
    out = []
    for i, (r, t) in enumerate(zip(rows, texts)):
        n = len(t) // 2
        new = t[: len(t) - n] + texts[(i + 1) % len(rows)][:n]
        fp = brute_print(new)
        far = lambda x: 1 - bin(prints[i] ^ x).count("1") / 128
        near = sum(bin(prints[i] ^ x).count("1") <= 6 for x in prints) - 1 if r[0] % 50 == 0 else None
        out.append((r[0], len(t), H(new), hexed(prints[i]), hexed(fp), far(fp), far(prints[(i + 1) % len(rows)]), near))
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 130])
def test_simhash_by_hand(spark, n):
    r = random.Random(n)
    vocabulary = [f"wört{i}" for i in range(60)] + ["\U0001f600x"]
    rows = []
    for i in range(n):
        text = " ".join(r.choices(vocabulary, k=r.choice([1, 3, 5, 40, 90])))
        rows.append((i * 10, None if i % 13 == 7 else "" if i % 13 == 8 else "same text of all of these" if i % 5 == 0 else text, "x", 1))
    if n > 2:
        rows.append((-7, " ".join(r.choices(vocabulary, k=40_000)), "x", 1))
    got = simhash.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string, chunk string, off long")).collect()
    rounded = lambda xs: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in xs], key=repr)
    assert rounded(map(tuple, got)) == rounded(brute_simhash(rows))


def test_simhash_null_ids_ties_and_repeats(spark):
    rows = [(None, "a b c d e f")] * 40 + [(3, "x y z")] * 40 + [(3, None), (None, None)]
    got = simhash.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 82 and len({r["fingerprint"] for r in got}) == 3
    same = [r for r in got if r["doc_id"] == 3 and r["n_chars"] == 5]
    assert sum(r["near_next"] == 1.0 for r in same) == 39  # equal rows follow each other


@pytest.mark.parametrize("radius, blocks, exact", [(6, None, 2), (3, 5, 1), (10, 14, 3), (0, None, 2)])
def test_all_fingerprints_within_a_radius(spark, radius, blocks, exact):
    r = random.Random(radius)
    base = [r.getrandbits(128) for _ in range(12)]
    every = {b for b in base} | {b ^ sum(1 << k for k in r.sample(range(128), r.randint(0, radius + 2))) for b in base for _ in range(25)}
    asked = sorted(every)[::7]
    words = lambda x: tuple(x >> 32 * k & 0xFFFFFFFF for k in range(4))
    q = spark.createDataFrame([words(x) for x in asked], "q0 long, q1 long, q2 long, q3 long")
    f = spark.createDataFrame([words(x) for x in every], "f0 long, f1 long, f2 long, f3 long")
    got = [tuple(x) for x in simhash.within(q, f, radius, blocks, exact).collect()]
    want = [(*words(a), *words(b), bin(a ^ b).count("1")) for a in asked for b in every if bin(a ^ b).count("1") <= radius]
    assert sorted(got) == sorted(want)


def test_simhash_is_native(spark):
    plan = simhash.fingerprint_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
    with pytest.raises(ValueError):
        simhash.within(plan, plan, 6, 7, 2)
