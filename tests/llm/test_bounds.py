"""What the driver and a task hold at the operators' own bounds."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, langid

ROOT = Path(__file__).parents[2]


def run_alone(code):
    """What a process of its own prints, whose peak memory is nobody else's; on one core, as a task is."""
    env = os.environ | {"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1"}
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True, timeout=600, env=env).stdout.split()


def test_a_benchmark_block_of_32_mb():
    got = run_alone("""
import pickle, resource
import numpy as np
from gleaner.llm.decontaminate import BLOCK_BYTES, Phrases
r = np.random.default_rng(1)
vocabulary = np.array(["".join(chr(97 + c) for c in r.integers(0, 26, r.integers(2, 9))) for _ in range(60000)], dtype=object)
texts, held = [], 0
while held < BLOCK_BYTES:
    texts.append(" ".join(vocabulary[np.minimum(r.zipf(1.3, 4000), 59999)]))
    held += len(texts[-1])
p = Phrases([str(i) for i in range(len(texts))], texts, 10)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024, len(pickle.dumps(p)) >> 20, held >> 20)
""")
    peak, closure, held = map(int, got)
    assert held >= 32 and peak < 700 and closure < 64


def test_learning_and_labelling_200_languages():
    got = run_alone("""
import resource, time
import numpy as np, pyarrow as pa
from gleaner.llm.langid import Field, _label
r = np.random.default_rng(1)
word = lambda: "".join(chr(97 + c) for c in r.integers(0, 26, r.integers(3, 8)))
own = [[word() for _ in range(300)] for _ in range(200)]
say = lambda l, n: " ".join(own[l][i] for i in r.integers(0, 300, n))
labels = [l for l in range(200) for _ in range(160)]
f = Field([f"l{i}" for i in range(200)])
f.train([say(l, 80) for l in labels], labels, rounds=4)
began = time.process_time()
rows = pa.RecordBatch.from_pylist([{"text": say(3, 160_000)}, {"text": say(77, 30)}])
told = [x for b in _label(f)(iter([rows])) for x in b.column("lang_pred").to_pylist()]
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024, int(time.process_time() - began), *told)
""")
    assert int(got[0]) < 700 and int(got[1]) < 60 and got[2:] == ["l3", "l77"]


def test_the_driver_gives_back_what_it_learned_from():
    got = run_alone("""
import os, psutil
import numpy as np
from pyspark.sql import SparkSession, functions as F
from gleaner.llm.langid import learn
from gleaner.llm.units import give_back
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
r = np.random.default_rng(1)
own = [["".join(chr(97 + c) for c in r.integers(0, 26, r.integers(3, 8))) for _ in range(3000)] for _ in range(6)]
rows = [(" ".join(own[l][i] for i in r.integers(0, 3000, 300)), f"l{l}") for l in range(6) for _ in range(300)]
docs = spark.createDataFrame(rows, "t string, l string")
del rows, own
give_back()
began = psutil.Process().memory_info().rss
field = learn(docs, "t", "l", F.lit(True))
held = psutil.Process().memory_info().rss
give_back()
print((held - psutil.Process().memory_info().rss) >> 20, (held - began) >> 20, len(field.languages))
spark.stop()
""")
    kept, more, languages = map(int, got[-3:])
    assert languages == 6 and kept < 10, (kept, more)


def test_messages_word_by_word_are_those_by_matrices():
    r = np.random.default_rng(4)
    windows = np.array([1, 3, 0, 1, 5, 2])
    n, l = int(windows.sum()), 7
    length = np.full(n, langid.WINDOW)
    last = np.cumsum(windows)[windows > 0] - 1
    length[last] = r.integers(1, langid.WINDOW, len(last))
    score = np.where(np.arange(langid.WINDOW)[None, :, None] < length[:, None, None], r.normal(0, 3, (n, langid.WINDOW, l)), 0).astype(np.float32)
    move = r.normal(0, 2, (l, l)).astype(np.float32)
    a = langid.forward_backward(score, length, move, *langid.between(score, length, move, windows))[0]
    for held in (1, 10**9):
        b = langid.forward_backward(score, length, move, *langid.between_words(lambda i: score[i], length, move, windows, held))[0]
        inside = np.arange(langid.WINDOW)[None, :] < length[:, None]
        assert np.allclose(a[inside], b[inside], atol=1e-4)


def test_labels_are_the_same_in_pieces_and_by_words(monkeypatch):
    r = np.random.default_rng(2)
    own = [["der", "und", "ist", "nicht"], ["the", "and", "is", "not"], ["le", "et", "est", "pas"]]
    texts = [" ".join(r.choice(own[i % 3], r.integers(1, 400))) for i in range(60)] + ["", "12 !"]
    f = langid.Field(["de", "en", "fr"])
    f.train(texts[:60], [i % 3 for i in range(60)])
    rows = pa.RecordBatch.from_pylist([{"text": t} for t in [*texts, " ".join(own[0] * 300 + own[2] * 900)]])
    one = [b.to_pylist() for b in langid._label(f)(iter([rows]))]
    monkeypatch.setattr(langid, "BY_MATRIX", 0)
    monkeypatch.setattr(langid, "HELD", 3 * langid.WINDOW * 2)
    two = [b.to_pylist() for b in langid._label(f)(iter([rows]))]
    for x, y in zip(sum(one, []), sum(two, [])):
        assert x["lang_pred"] == y["lang_pred"] and abs(x["score"] - y["score"]) < 1e-4 and x["runs"] == y["runs"]


def test_learning_in_batches_is_learning_at_once(monkeypatch):
    r = np.random.default_rng(3)
    texts = [" ".join(r.choice(["aa", "bb", "cc", "dd"] if i % 2 else ["aa", "xx", "yyyyyyyyyyyyyyy", "zz"], 120)) for i in range(40)]
    fields = []
    for held in (langid.HELD, 2 * langid.WINDOW * 3):
        monkeypatch.setattr(langid, "HELD", held)
        fields.append(langid.Field(["a", "b"]))
        fields[-1].train(texts, [i % 2 for i in range(40)], rounds=6)
    assert np.allclose(fields[0].weights, fields[1].weights, atol=1e-3) and np.allclose(fields[0].move, fields[1].move, atol=1e-3)


def test_a_language_beyond_its_share_of_bytes_is_learned_from_less(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "TOTAL_BYTES", 4000)
    monkeypatch.setattr(langid.Field, "train", lambda self, texts, labels: seen.extend(zip(texts, labels)))
    rows = [(i, f"{'de'} {i} " + "wort " * 100, "de", "x") for i in range(30)] + [(100 + i, f"en {i}", "en", "x") for i in range(5)] + [(200, "lone " * 5000, "fr", "x")]
    langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), "text", "lang", F.lit(True))
    size = lambda l: [len(t) for t, x in seen if x == l]
    assert 1 <= len(size(0)) <= 2 and len(size(1)) == 5 and size(2) == [25_000]


def test_carried_columns_of_the_new_names_are_replaced(spark):
    df = spark.createDataFrame([(1, "der und", "de", "x", 1, 2), (2, None, None, "y", 1, 2)], "doc_id long, text string, lang string, lang_pred string, score int, `a.b` int")
    out = langid.identify(df, F.lit(True), carry=["doc_id", "lang_pred", "a.b", "text", "score"])
    assert out.columns == ["doc_id", "a.b", "text", "lang_pred", "score", "runs"]
    assert sorted((r["doc_id"], r["lang_pred"], r["text"], r["a.b"]) for r in out.collect()) == [(1, "de", "der und", 2), (2, "und", None, 2)]


def test_windows_in_several_places_and_items(monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK", 5)
    p = decontaminate.Phrases(["1", "2", "1", None, "4"], ["a b c a b c", "b c a", "b c a", None, "x"], 3)
    starts = p.firsts()
    rows, lengths = p.rows(starts)
    assert len(starts) == 4 and sorted(lengths) == [1, 3, 3, 3] and p.least == 1
    of, item = p.items_of(np.arange(4), starts)
    got = {tuple(rows[i]): {p.names[c] for c in item[of == i]} for i in range(4)}
    assert sorted(map(sorted, got.values())) == [["1"], ["1"], ["1", "2"], ["4"]]
