"""Whole queries against plain code: sharding, language ID, toxicity."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from gleaner.llm import langid, sharding, toxicity
from gleaner.llm.units import Hasher


def differenced(sizes, k):
    """Sums of k parts by differencing, with lists only."""
    parts = [tuple(sorted([s] + [0] * (k - 1), reverse=True)) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0] - p[-1])
        a, b = parts.pop(), parts.pop()
        parts.append(tuple(sorted((x + y for x, y in zip(a, reversed(b))), reverse=True)))
    return sorted(parts[0])


def test_shards_are_those_of_plain_differencing(spark):
    r = random.Random(12)
    texts = [chr(97 + i % 26) * n for i, n in enumerate(r.sample(range(1, 60_000), 90))]  # sizes without ties
    rows = [(i, t) for i, t in enumerate(texts)] + [(500 + i, texts[i % 7]) for i in range(30)] + [(900, None), (901, "é")]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    groups = Counter()
    for _, t in rows:
        groups[t] += len((t or "").encode()) + 1
    sums, where = Counter(), {}
    by_id = dict(rows)
    for x in got:
        t = by_id[x["doc_id"]]
        assert x["size"] == len((t or "").encode()) + 1 and x["text_crc32"] == (None if t is None else zlib.crc32(t.encode()))
        assert where.setdefault(t, x["shard"]) == x["shard"] and x["law"] == "bytes" and x["grown_shard"] is None
        sums[x["shard"]] += x["size"]
    assert sorted(sums[s] for s in range(8)) == differenced(groups.values(), 8)


def plain_posteriors(score, move):
    """Shares of each language at each word, by forward-backward over plain sums."""
    n, l = len(score), len(move)
    lse = lambda xs: (m := max(xs)) + math.log(sum(math.exp(x - m) for x in xs))
    f = [list(score[0])]
    for t in range(1, n):
        f.append([score[t][j] + lse([f[-1][i] + move[i][j] for i in range(l)]) for j in range(l)])
    b = [[0.0] * l]
    for t in range(n - 2, -1, -1):
        b.append([lse([move[i][j] + score[t + 1][j] + b[-1][j] for j in range(l)]) for i in range(l)])
    b.reverse()
    out = []
    for t in range(n):
        both = [x + y for x, y in zip(f[t], b[t])]
        z = lse(both)
        out.append([math.exp(x - z) for x in both])
    return out


def test_language_of_whole_texts_by_plain_sums(spark):
    r = random.Random(6)
    own = {"de": "der und nicht schön über machen auch".split(), "en": "the and with there thing going about".split(), "fr": "le et pas être avec très où".split()}
    rows = []
    for i in range(160):
        lang = r.choice([*own])
        words = [r.choice(own[lang] if r.random() < 0.9 else own[r.choice([*own])]) for _ in range(r.choice([1, 5, 60, 64, 65, 200]))]
        rows.append((i, " ".join(words) + r.choice(["", ".", " 12"]), lang if r.random() < 0.9 else None))
    rows += [(200, None, "de"), (201, "", "en"), (202, "12 34", "en"), (203, rows[5][1], None), (None, rows[6][1], "fr")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {x["doc_id"]: x for x in langid.identify_documents(docs).collect()}
    field = langid.learn(docs, "text", "lang", ~langid.held_out())
    assert field.languages == ["de", "en", "fr"]
    for i, text, _ in rows:
        held = i is not None and zlib.crc32(str(i).encode()) % 3 == 1
        x = got[i]
        assert x["held_out"] == held
        if not text or not re.search(r"[^\W\d_]", text):
            assert (x["lang_pred"], x["score"]) == ("und", 0.0)
            continue
        _, key, feats, later, which = langid._read(pa.array([text], pa.large_string()), Hasher(langid.SEED))
        score = field.emit(key, feats, later)[which].astype(float)
        shares = np.mean(plain_posteriors(score.tolist(), field.move.astype(float).tolist()), axis=0)
        best = int(np.argmax(shares))
        assert x["lang_pred"] == field.languages[best] and abs(x["score"] - shares[best]) < 1e-3


def test_toxicity_of_whole_texts_is_the_noisy_or_of_their_sentences(spark):
    r = random.Random(9)
    plain, bad = "the sun was over a green field and we went home".split(), "idiot moron scum".split()
    rows, labels = [], []
    for i in range(240):
        toxic = i % 4 == 0
        sentences = [" ".join(r.choices(plain, k=r.randint(2, 9))) for _ in range(r.randint(1, 8))]
        if toxic:
            sentences[r.randrange(len(sentences))] += f" you {r.choice(bad)} {r.choice(bad)}"
        rows.append((i, "".join(s + r.choice([". ", "! ", "?\n", "\n"]) for s in sentences)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, "..."), (903, "no break at the end you idiot")]
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {x["doc_id"]: x for x in toxicity.toxicity_documents(docs, marks).collect()}
    model = toxicity.learn(docs, marks, ~toxicity.held_out())

    def alone(sentence):
        feats, which, of, _, ends, _ = toxicity._read(pa.array([sentence], pa.large_string()), Hasher(toxicity.SEED))
        z = model.bias + sum(float(model.weights[feats[w]].sum()) for w in which)
        assert len(ends) == 1 and not of.any()
        return 1 / (1 + math.exp(-z))

    for i, text in rows:
        none = 1.0
        for s in re.findall(r"[^.!?\n]*[.!?\n]|[^.!?\n]+$", text or ""):
            none *= 1 - alone(s)
        x = got[i]
        assert abs(x["score"] - (1 - none)) < 1e-6 and x["predicted"] == (x["score"] >= 0.5) and x["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [(got[i]["predicted"], t) for i, t in labels if got[i]["held_out"]]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)
