"""Language of each word and document by a linear-chain conditional random field.

Words have hashed features (the word, affixes, n-grams) and lexicon features;
the transitions between languages are learned too. Training sequences are
spliced from documents of several languages, so that the field sees switches.
Forward-backward gives each word's distribution over languages; a document's
language is the one with the largest mean.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import small_batches
from .units import LETTER, U, Hasher, flat, give_back, ranges, slices, words
from .wordfeatures import later_grams, lowered, word_features

DIM = 1 << 15
WINDOW = 64
#: At most so many labelled documents of each language are learned from.
PER_LANGUAGE = 400
#: Longer texts are not learned from (they are predicted like others), so that the sample has a bound in bytes.
SAMPLE_BYTES = 64 << 10
#: The commonest languages, so many, are learned; a rarer value of lang is never predicted.
MAX_LANGUAGES = 200
LEXICON = 200
#: Bytes of text that are learned from, of all languages together, dealt equally; and words times languages that a round of learning goes through.
TOTAL_BYTES, CELLS = 16 << 20, 10_000_000
#: Words times languages that are held at once; and languages up to which messages go from window to window by matrices.
HELD, BY_MATRIX = 4_000_000, 16
HEADS, TAILS, GRAM, GRAMS = (1, 2, 3, 4), (1, 2, 3, 4), 3, 8
SEED = 31


def _read(column: pa.Array, h: Hasher):
    """Each text's range among the words; the distinct words' hashes and features, and what n-grams they have beyond; each word's number among them."""
    raw, off = flat(column)
    low = lowered(raw)
    a, b, at = words(low, off, LETTER)
    p = h.prefix(h.of_byte[low])
    key, first, which = np.unique(h.span(p, a, b), return_index=True, return_inverse=True)
    a, b = a[first], b[first]
    return at, key, word_features(h, p, a, b, DIM, HEADS, TAILS, GRAM, GRAMS), later_grams(h, p, a, b, DIM, GRAM, GRAMS), which


def _read_many(texts: Sequence[str], h: Hasher):
    """As _read(), from slices of the texts, so that only their distinct words and the words' numbers are held."""
    parts = [_read(piece.column("text"), h) for piece in slices(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])]))] or [_read(pa.array([], pa.large_string()), h)]
    start = np.cumsum([0] + [len(p[1]) for p in parts])
    key, first, which = np.unique(np.concatenate([p[1] for p in parts]), return_index=True, return_inverse=True)
    feats = np.concatenate([p[2].astype(np.int32) for p in parts])[first]
    word, feat = (np.concatenate([p[3][0] + s for p, s in zip(parts, start)]), np.concatenate([p[3][1] for p in parts]))
    mine = first[which[word]] == word  # those of a word's first slice
    word, feat = which[word[mine]], feat[mine]
    order = np.argsort(word, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[0]) for p in parts]))])
    return at, key, feats, (word[order], feat[order]), np.concatenate([which[s + p[4]] for p, s in zip(parts, start)])


def forward_backward(
    score: np.ndarray, length: np.ndarray, move: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors (s x t x l), expected transitions (l x l) and log-likelihood's normalisers (s).

    score: emission log-potentials, padded; length: words of each sequence; move: transition log-potentials. enter, leave: what comes
    forward to the first word and backward to the last (s x l) where a sequence is a part of a longer one."""
    s, t, l = score.shape
    top = score.max(axis=2, keepdims=True)
    e = np.exp(score - top)
    m = np.exp(move)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    if enter is not None:
        e[:, 0] *= enter
    last = np.ones((s, l), dtype=e.dtype) if leave is None else leave.astype(e.dtype)
    beta[:] = last[:, None, :]
    norm = np.ones((s, t), dtype=e.dtype)
    alpha[:, 0] = e[:, 0]
    for i in range(t):
        if i:
            alpha[:, i] = (alpha[:, i - 1] @ m) * e[:, i]
        norm[:, i] = alpha[:, i].sum(axis=1)
        alpha[:, i] /= norm[:, i, None]
    for i in range(t - 2, -1, -1):
        nxt = (e[:, i + 1] * beta[:, i + 1]) @ m.T / norm[:, i + 1, None]
        beta[:, i] = np.where((i + 1 < length)[:, None], nxt, last)
    inside = np.arange(t) < length[:, None]
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    pairs = np.zeros((l, l))
    for i in range(t - 1):
        live = i + 1 < length
        right = e[live, i + 1] * beta[live, i + 1] / norm[live, i + 1, None]
        pairs += (alpha[live, i].T @ right) * m
    logz = np.where(inside, np.log(norm) + top[:, :, 0], 0).sum(axis=1)
    return post, pairs, logz


def between(score: np.ndarray, length: np.ndarray, move: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """enter and leave of windows that make up longer sequences. windows: how many each sequence has, one after the other.

    Each window's steps are multiplied into one matrix, all windows at once; these carry the messages from window to window."""
    n, t, l = score.shape
    m = np.exp(move.astype(score.dtype))
    e = np.exp(score - score.max(axis=2, keepdims=True))
    if not (windows > 1).any():
        return np.ones((n, l)), np.ones((n, l))
    by = np.argsort(-length, kind="stable")  # the longer first, so that each step is over a slice
    live, steps = np.searchsorted(-length[by], -np.arange(t), side="left"), e[by]
    product = np.broadcast_to(np.eye(l, dtype=score.dtype), (n, l, l)).copy()
    for i in range(t):
        k = live[i]
        x = (product[:k].reshape(-1, l) @ m).reshape(-1, l, l)
        x *= steps[:k, i, None, :]
        if i % 4 == 3 or i == t - 1:
            x /= x.max(axis=(1, 2), keepdims=True)
        product[:k] = x
    through = np.empty_like(product)
    through[by] = product / product.max(axis=(1, 2), keepdims=True)
    enter, leave = np.ones((n, l)), np.ones((n, l))
    scaled = lambda x: x / x.max(axis=1, keepdims=True)
    at = (np.cumsum(windows) - windows)[windows > 1]  # each longer sequence's first window
    many = windows[windows > 1]
    x = e[at, 0]
    for i in range(1, t):
        x = scaled((x @ m) * e[at, i])
    for k in range(1, int(many.max())):
        x, now = x[many[many >= k] > k], at[many > k] + k
        enter[now] = scaled(x @ m)
        x = scaled(np.einsum("sa,sab->sb", x, through[now]))
    for k in range(int(many.max()) - 1, 0, -1):
        now = at[many > k] + k
        leave[now - 1] = scaled(np.einsum("sab,sb->sa", through[now], leave[now]))
    return enter, leave


def between_words(score_of: Callable[[np.ndarray], np.ndarray], length: np.ndarray, move: np.ndarray, windows: np.ndarray, held: int = HELD) -> tuple[np.ndarray, np.ndarray]:
    """As between(), word by word: for many languages, where a matrix for each window would be far more work than the vectors that go through it. score_of: the scores of some windows, by number."""
    n, l = len(length), len(move)
    m = np.exp(move.astype(np.float32))
    back = np.ascontiguousarray(m.T)
    enter, leave = np.ones((n, l), dtype=np.float32), np.ones((n, l), dtype=np.float32)
    first, some = np.cumsum(windows) - windows, max(1, held // (WINDOW * l))
    scaled = lambda x: x / x.max(axis=1, keepdims=True)
    grown = lambda i: np.exp((x := score_of(i)) - x.max(axis=2, keepdims=True))
    for k in range(int(windows.max(initial=0)) - 1):
        now = first[windows > k + 1] + k
        for i in range(0, len(now), some):
            at = now[i : i + some]
            e = grown(at)
            x = e[:, 0] * (enter[at] if k else 1)
            for t in range(1, WINDOW):
                x = (x @ m) * e[:, t]
                x = scaled(x) if t % 4 == 3 else x
            enter[at + 1] = scaled(x @ m)
    for k in range(int(windows.max(initial=0)) - 1, 0, -1):
        now = first[windows > k] + k
        for i in range(0, len(now), some):
            at = now[i : i + some]
            e, size = grown(at), length[at]
            x = leave[at].copy()
            for t in range(int(size.max()) - 1, -1, -1):
                live = size > t
                if live.all():
                    x = (e[:, t] * x) @ back
                else:
                    x[live] = (e[live, t] * x[live]) @ back
                x = scaled(x) if t % 4 == 0 else x
            leave[at - 1] = x
    return enter, leave


class Field:
    """Weights of the features (and one row of zeros), of the lexicons, and of the transitions."""

    def __init__(self, languages: Sequence[str]):
        self.languages = list(languages)
        n = len(self.languages)
        self.weights = np.zeros((DIM + 1, n), dtype=np.float32)
        self.lexicon = np.zeros(0, dtype=U)  # sorted
        self.listed = np.zeros((0, n), dtype=np.float32)  # in which languages' lists each word is
        self.listed_weight = np.zeros((n, n), dtype=np.float32)
        self.move = np.zeros((n, n), dtype=np.float32)

    def lists(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros((len(key), len(self.languages)), dtype=np.float32)
        if len(self.lexicon):
            i = np.minimum(np.searchsorted(self.lexicon, key), len(self.lexicon) - 1)
            ok = self.lexicon[i] == key
            out[ok] = self.listed[i[ok]]
        return out

    def emit(self, key: np.ndarray, feats: np.ndarray, later: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        out = self.lists(key) @ self.listed_weight
        for j in range(feats.shape[1]):
            out += self.weights[feats[:, j]]
        word, feat = later
        if len(word):
            for i in range(len(self.languages)):
                out[:, i] += np.bincount(word, weights=self.weights[feat, i], minlength=len(key))
        return out

    def train(self, texts: Sequence[str], labels: Sequence[int], rounds: int = 40, rate: float = 0.15, decay: float = 1e-5) -> None:
        h, n = Hasher(SEED), len(self.languages)
        at, key, feats, later, which = _read_many(texts, h)
        label = np.repeat(np.asarray(labels), np.diff(at))
        # Lexicons: the words most typical of a language, in which a word's share is more than that in all others together.
        pair, count = np.unique(which.astype(np.int64) * n + label, return_counts=True)
        word, of = pair // n, pair % n
        share = count / np.maximum(np.bincount(of, weights=count, minlength=n), 1)[of]
        typical = (share > 0.6 * np.bincount(word, weights=share, minlength=len(key))[word]) & (count > 1)
        word, of, count = word[typical], of[typical], count[typical]
        best = np.lexsort((word, -count, of))
        best = best[ranges(np.bincount(of, minlength=n)) < LEXICON]
        some = np.sort(word[best])
        self.lexicon, self.listed = key[some], np.zeros((len(some), n), dtype=np.float32)
        self.listed[np.searchsorted(some, word[best]), of[best]] = 1
        # Runs of 4 to 24 words from the documents in a seeded order, spliced into sequences.
        rng = np.random.default_rng(SEED)
        runs = []
        for d in rng.permutation(len(texts)):
            x, y = int(at[d]), int(at[d + 1])
            for _ in range(4):
                if y > x:
                    size = int(rng.integers(4, 25))
                    s = int(rng.integers(x, max(x + 1, y - size + 1)))
                    runs.append(np.arange(s, min(y, s + size)))
        order = np.concatenate(runs) if runs else np.zeros(0, dtype=np.int64)
        if not len(order):
            return
        t = min(WINDOW, len(order))
        order = order[: min(len(order), max(t, CELLS // n)) // t * t].reshape(-1, t)
        y = label[order]
        truth_moves = np.zeros((n, n))
        np.add.at(truth_moves, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        size = max(1, HELD // (t * n))
        batches = [(order[i : i + size], y[i : i + size], *np.unique(which[order[i : i + size]], return_inverse=True)) for i in range(0, len(order), size)]
        params = [self.weights, self.listed_weight, self.move]
        square = [np.zeros(p.shape, dtype=np.float64) for p in params]
        for _ in range(rounds):
            grads = [np.zeros(p.shape, dtype=np.float64) for p in params]
            for part, truth, seen, word in batches:
                word = word.reshape(part.shape)
                f, k, (of, feat) = feats[seen], key[seen], _some(later, seen)
                score = self.emit(k, f, (of, feat))[word]
                post, pairs, _ = forward_backward(score, np.full(len(part), t), self.move)
                np.negative(post, out=post)
                post.reshape(-1, n)[np.arange(part.size), truth.ravel()] += 1
                diff = post.reshape(-1, n) / len(order)
                of_word = np.stack([np.bincount(word.ravel(), weights=diff[:, i], minlength=len(seen)) for i in range(n)], axis=1)
                for i in range(n):
                    grads[0][:, i] += np.bincount(f.ravel(), weights=np.repeat(of_word[:, i], f.shape[1]), minlength=DIM + 1)
                    if len(of):
                        grads[0][:, i] += np.bincount(feat, weights=of_word[of, i], minlength=DIM + 1)
                grads[1] += self.lists(k).T @ of_word
                grads[2] -= pairs / len(order)
            grads[0][DIM] = 0
            grads[0] -= decay * self.weights
            grads[2] += truth_moves / len(order)
            for p, g, q in zip(params, grads, square):
                for i in range(0, len(p), 4096):
                    rows = slice(i, i + 4096)
                    q[rows] += g[rows] * g[rows]
                    p[rows] += (rate * g[rows] / np.sqrt(q[rows] + 1e-12)).astype(np.float32)
            self.weights[DIM] = 0


def _some(later: tuple[np.ndarray, np.ndarray], seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The further n-grams of some words (ascending), by their place among these."""
    low, high = np.searchsorted(later[0], seen), np.searchsorted(later[0], seen, side="right")
    k = high - low
    return np.repeat(np.arange(len(seen)), k), later[1][np.repeat(low, k) + ranges(k)]


def _label(field: Field):
    """(…, lang_pred, score, runs of words of one language) of every text."""
    n = len(field.languages)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher(SEED)
        for piece in slices(batches):
            at, key, feats, later, which = _read(piece.column("text"), h)
            count = np.diff(at)
            windows = -(-count // WINDOW)
            head = np.repeat(at[:-1], windows) + ranges(windows) * WINDOW
            length = np.minimum(WINDOW, np.repeat(at[1:], windows) - head)
            total = np.zeros((len(count), n))
            best = np.zeros(len(which), dtype=np.int64)

            def score_of(i: np.ndarray) -> np.ndarray:
                """Scores of windows by number, of which only their words' features are looked up."""
                place = np.repeat(head[i], length[i]) + ranges(length[i])
                seen, word = np.unique(which[place], return_inverse=True)
                out = np.zeros((len(i), WINDOW, n), dtype=np.float32)
                out.reshape(-1, n)[np.repeat(np.arange(len(i)) * WINDOW, length[i]) + ranges(length[i])] = field.emit(key[seen], feats[seen], _some(later, seen))[word]
                return out

            def told(i: np.ndarray, score: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> None:
                cell = np.repeat(np.arange(len(i)) * WINDOW, length[i]) + ranges(length[i])
                post = forward_backward(score, length[i], field.move, enter, leave)[0].reshape(-1, n)[cell]
                best[np.repeat(head[i], length[i]) + ranges(length[i])] = post.argmax(axis=1)
                cut = np.cumsum(length[i]) - length[i]
                np.add.at(total, owner[i], np.add.reduceat(post.astype(np.float64), cut, axis=0))

            owner, every = np.repeat(np.arange(len(count)), windows), np.arange(len(head))
            if n <= BY_MATRIX and len(head):
                score = score_of(every)
                told(every, score, *between(score, length, field.move, windows))
            elif len(head):
                enter, leave = between_words(score_of, length, field.move, windows)
                size = max(1, HELD // (WINDOW * n))
                for i in range(0, len(head), size):
                    told(every[i : i + size], score_of(every[i : i + size]), enter[i : i + size], leave[i : i + size])
            mean = total / np.maximum(count, 1)[:, None]
            pick = mean.argmax(axis=1)
            # Runs of equal labels.
            edge = np.zeros(len(which) + 1, dtype=bool)
            edge[at] = True
            new = np.flatnonzero(np.r_[True, best[1:] != best[:-1]] | edge[:-1]) if len(which) else np.zeros(0, dtype=np.int64)
            size = np.diff(np.r_[new, len(which)])
            runs = pa.StructArray.from_arrays([pa.array(np.array(field.languages, dtype=object)[best[new]], pa.string()), pa.array(size, pa.int64())], fields=list(kind.value_type))
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(new, at), pa.int32()), runs)
            score = np.where(count > 0, mean[np.arange(len(count)), pick], 0.0)
            yield pa.RecordBatch.from_arrays(
                [*[piece.column(c) for c in piece.schema.names], pa.array([field.languages[i] for i in pick], pa.string()), pa.array(np.clip(score, 0, 1)), spans],
                names=[*piece.schema.names, "lang_pred", "score", "runs"],
            )

    return run


def learn(docs: DataFrame, text: str, lang: str, usable: Column, per_language: int = PER_LANGUAGE) -> Field | None:
    """A field trained from a sample of the distinct usable texts, about per_language of each language (at most twice that, those of
    the least hashes; ties in the hash by text; and no more than its share of TOTAL_BYTES but for one text), none over SAMPLE_BYTES long; none without rows."""
    rows = docs.filter(usable & F.col(lang).isNotNull() & (F.octet_length(text) <= SAMPLE_BYTES))
    counts = rows.groupBy(lang).agg(F.approx_count_distinct(F.xxhash64(text), 0.02).alias("count")).orderBy(F.desc("count"), lang).limit(MAX_LANGUAGES).collect()
    if not counts:
        return None
    languages = sorted(r[0] for r in counts)
    draw = F.pmod(F.xxhash64(F.lit(SEED), text), F.lit(1_000_000))
    cut = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(1_000_000, per_language * 1_000_000 // r[1] + 1))])
    drawn = rows.filter(draw < F.element_at(cut, F.col(lang))).select(text, lang).distinct().withColumn("h", F.xxhash64(text))
    in_turn = Window.partitionBy(lang).orderBy("h", text)
    drawn = drawn.withColumns({"__n": F.row_number().over(in_turn), "__b": F.sum(F.octet_length(text)).over(in_turn.rowsBetween(Window.unboundedPreceding, 0))})
    picked = drawn.filter(F.col("__n") <= 2 * per_language).filter((F.col("__b") <= TOTAL_BYTES // len(languages)) | (F.col("__n") == 1)).collect()
    picked.sort(key=lambda r: (r["h"], r[1], r[0]))
    field = Field(languages)
    field.train([r[0] for r in picked], [languages.index(r[1]) for r in picked])
    del picked
    give_back()  # the driver would hold what was learned from for as long as it runs
    return field


def identify(docs: DataFrame, usable: Column, carry: Sequence[str] = ("doc_id",), text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """The carried columns with lang_pred, score and runs (language and number of words, in order).

    `usable` says which rows may be learned from. Texts without a letter, null and empty ones are `und` with
    score 0, and so is everything where nothing can be learned. A run's words are of ASCII letters and characters beyond
    ASCII; the field runs over a whole text, in windows of 64 words that hand their messages on.
    Equal texts get equal results. The new columns replace carried ones of their names. No shuffle but the counts of languages and the drawn texts.
    """
    small_batches(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    field = learn(docs.select(F.col(f"`{text}`").alias("__t"), F.col(f"`{lang}`").alias("__l"), usable.alias("__u")), "__t", "__l", F.col("__u"), per_language)
    runs = "array<struct<lang:string,words:long>>"
    carry = [c for c in carry if c not in ("lang_pred", "score", "runs")]
    at = {c: f"__c{i}" for i, c in enumerate(carry) if c != text}
    kept = list(at.values())
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in at.items()], F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{text}`").rlike("\\p{L}"), F.lit(False)).alias("__letters"))
    kinds = {k: kinds[c] for c, k in at.items()}
    if field is None:
        out = rows.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast(runs).alias("runs"))
    else:
        typed = "".join(f"`{c}` {kinds[c]}, " for c in kept)
        out = rows.mapInArrow(_label(field), f"{typed}text string, __letters boolean, lang_pred string, score double, runs {runs}")
    return out.select(
        *[F.col("text" if c == text else at[c]).alias(c) for c in carry],
        F.when(F.col("__letters"), F.col("lang_pred")).otherwise("und").alias("lang_pred"),
        F.when(F.col("__letters"), F.col("score")).otherwise(0.0).alias("score"), "runs",
    )


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def identify_documents(docs: DataFrame) -> DataFrame:
    """One row for every row of documents; `und` with score 0 for null and empty texts and those without a letter. A null doc_id is not held out."""
    out = identify(docs.select("doc_id", "text", "lang"), ~held_out())
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
