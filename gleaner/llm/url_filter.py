"""URL filter: logistic regression on hashed character n-grams of host and path.

The regression is trained by full-batch gradient descent (each weight's step by its gradients so far) over arrays, inside
one SQL expression, from a small labelled table, of which parts are held out: one to choose the threshold on, one for tests. Rules on host suffix and path
prefix come first. Native expressions only.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textsql import lower_ascii

DIM = 4096
MAX_LABELLED = 2000
EPOCHS = 30
RATE = 1.0
DECAY = 1e-5
#: Of the labelled rows, by hash of the url, one in SPLITS chooses the threshold and one is never looked at (a test of the model); the others train.
SPLITS = 5

#: Words that addresses worth reading are made of, and words of those that are to go: common words of either kind, from no data set.
WANTED = (
    "news politics economy election weather report review article blog docs manual guide tutorial reference library python linux kernel database query network security research science "
    "physics chemistry biology medicine hospital health nutrition school university course lecture student history museum archive gallery painting music concert theatre film book novel poetry "
    "journal magazine travel hotel railway map city council government law court justice sport football tennis cycling garden recipe kitchen cooking bread forum community wiki project release "
    "download support help contact about team career jobs engineering software hardware camera phone energy climate nature forest animal birds ocean mountain farm market bank tax insurance"
).split()
UNWANTED = (
    "casino poker slots roulette jackpot betting bonus viagra cialis pills pharma weightloss porn xxx adult escort hookup dating nude crack keygen warez torrent cheats replica rolex outlet cheap discount "
    "freebie winner lottery giveaway payday loans forex crypto airdrop getrich clickbait spam backlinks followers popup banner adserver tracker redirect affiliate"
).split()
HOSTS = ("www", "blog", "shop", "m", "cdn", "my", "old", "en", "online", "portal")
ENDINGS = ("com", "org", "net", "edu", "info", "de", "co.uk", "fr", "io", "eu")
ODD_ENDINGS = ("xyz", "top", "club", "biz", "click", "win", "loan", "bid")


def _name(rng: random.Random) -> str:
    """A name that says nothing: consonants and vowels by turns."""
    return "".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) + rng.choice(["", "n", "r", "s", "x"])


def labelled_urls(n: int = 1800) -> list[tuple[str, int]]:
    """n invented addresses with labels (1: block), by rule: the i-th is drawn with seed i, a quarter each of words that are wanted and of words that are not, and half of names that say
    nothing (label 0). Now and then a wanted or empty name stands beside an unwanted word, and paths have dates, numbers and file names as addresses of the web have."""
    out = []
    for i in range(n):
        rng = random.Random(i)
        bad = i % 4 == 1
        word = [lambda: rng.choice(WANTED), lambda: rng.choice(UNWANTED), lambda: _name(rng), lambda: _name(rng)][i % 4]
        other = lambda: rng.choice([word] * 8 + [lambda: rng.choice(WANTED), lambda: _name(rng)])()
        joined = rng.choice(["-", "", "-"])
        host = [f"{rng.choice(HOSTS)}.{word()}{joined}{other()}", f"{word()}{joined}{other()}", word(), f"{other()}.{word()}", f"{rng.choice(HOSTS)}.{word()}{rng.randrange(1, 400)}"][rng.randrange(5)]
        parts = [rng.choice([other, lambda: str(rng.randrange(1, 99999)), lambda: f"{rng.randrange(2001, 2026)}/{rng.randrange(1, 13):02}", lambda: f"{other()}-{other()}"])() for _ in range(rng.randrange(1, 4))]
        path = "/".join(parts) + rng.choice([".html", "", "", ".php", "/"])
        out.append((f"http{rng.choice(['', 's'])}://{host}.{rng.choice(ODD_ENDINGS if bad and rng.random() < 0.6 else ENDINGS)}/{path}", int(bad)))
    return out


#: (host and path, verdict), as the query fixes them.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null or without `://`."""
    u = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(u, _URL, 1)), F.regexp_extract(u, _URL, 2)


def with_features(df: DataFrame, host: str, path: str, dim: int = DIM) -> DataFrame:
    """df with __f: the distinct buckets of the 3- and 4-grams of host and path."""
    chars = df.withColumn("__h", F.split(F.concat(F.lit("^"), F.col(host), F.lit("$")), "", -1)).withColumn(
        "__p", F.split(F.concat(F.lit("^"), F.col(path), F.lit("$")), "", -1)
    )

    def grams(name: str, k: int) -> Column:
        n = F.size(name)
        return F.when(
            n >= k,
            F.transform(
                F.sequence(F.lit(0), n - k),
                lambda i: F.pmod(F.xxhash64(F.lit(name), F.concat(*[F.get(name, i + j) for j in range(k)])), F.lit(dim)).cast("int"),
            ),
        ).otherwise(F.array().cast("array<int>"))

    found = F.array_distinct(F.concat(*[grams(c, k) for c in ("__h", "__p") for k in (3, 4)]))
    return chars.withColumn("__f", found).drop("__h", "__p")


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def train(labelled: DataFrame, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY, most: int = MAX_LABELLED) -> list[float]:
    """dim weights and a bias from (url, label); at most `most` rows, those
    with the lowest hashes of their urls. Rows with null url or label don't count. Without rows all weights are 0."""
    rows = labelled.filter("url IS NOT NULL AND label IS NOT NULL").select("url", F.col("label").cast("double").alias("y"))
    rows = rows.orderBy(F.xxhash64("url"), "url", "y").limit(most)
    host, path = url_parts(F.col("url"))
    rows = with_features(rows.withColumn("host", host).withColumn("path", path), "host", "path", dim)
    number = F.row_number().over(Window.orderBy("url", "y")) - 1  # of at most `most` rows
    ex = rows.select(F.struct(number.alias("i"), "y", (F.lit(1.0) / F.sqrt(F.greatest(F.size("__f"), F.lit(1)))).alias("s"), F.col("__f").alias("f")).alias("ex"))
    # For each bucket the examples that have it.
    lists = ex.select("ex.i", "ex.s", F.explode("ex.f").alias("j")).groupBy("j").agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("o"))
    both = ex.withColumn("in", F.lit(None)).unionByName(lists.select(F.lit(None).alias("ex"), F.struct("j", "o").alias("in")))
    one = both.agg(F.sort_array(F.collect_list("ex")).alias("ex"), F.map_from_entries(F.collect_list("in")).alias("of"))
    one = one.select("ex", F.size("ex").alias("n"), F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.element_at("of", j)).alias("inv"))
    tiny = F.lit(1e-12)
    start = F.struct(F.array_repeat(F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("q")), dim).alias("m"), F.lit(0.0).alias("b"), F.lit(0.0).alias("q"))

    def step(s: Column, _: Column) -> Column:
        wrong = F.transform("ex", lambda e: e["y"] - sigmoid(s["b"] + e["s"] * _sum(F.transform(e["f"], lambda j: F.get(s["m"], j)["w"]))))

        def next_weight(m: Column, g: Column) -> Column:
            return F.struct((m["w"] + rate * g / F.sqrt(m["q"] + g * g + tiny)).alias("w"), (m["q"] + g * g).alias("q"))

        def follow(r: Column) -> Column:
            slope = lambda m, j: F.coalesce(_sum(F.transform(F.get(F.col("inv"), j), lambda o: o["s"] * F.get(r, o["i"]))), F.lit(0.0)) / F.col("n") - decay * m["w"]
            g = _sum(r) / F.col("n")
            return F.struct(
                F.transform(s["m"], lambda m, j: _let(slope(m, j), lambda x: next_weight(m, x))).alias("m"),
                (s["b"] + rate * g / F.sqrt(s["q"] + g * g + tiny)).alias("b"), (s["q"] + g * g).alias("q"),
            )

        return _let(wrong, follow)

    model = one.filter("n > 0").select(F.aggregate(F.sequence(F.lit(1), F.lit(epochs)), start, step).alias("m")).first()
    return [*[x["w"] for x in model["m"]["m"]], model["m"]["b"]] if model else [0.0] * (dim + 1)


def score(features: Column, weights: list[float]) -> Column:
    """The model's score of a row's buckets. The weights are a literal of the plan, of fixed size."""
    w = F.split(F.lit(",".join(map(repr, weights[:-1]))), ",").cast("array<double>")
    return sigmoid(F.lit(weights[-1]) + _sum(F.transform(features, lambda j: F.get(w, j))) / F.sqrt(F.greatest(F.size(features), F.lit(1))))


def split_of(url: Column) -> Column:
    """Which part of the labelled rows a url is in: 0 chooses the threshold, 1 is only for tests, the others train."""
    return F.pmod(F.crc32(F.coalesce(url, F.lit(""))), F.lit(SPLITS))


def fit(labelled: DataFrame, dim: int = DIM) -> tuple[list[float], float]:
    """Weights from the training rows of labelled, and of the thresholds 0.05 to 0.95 the one that is wrong on fewest of the choosing rows, where
    blocking a row that is to stay counts twice (of several the nearest to 0.5, then the largest). 0.5 without rows to choose on."""
    weights = train(labelled.filter(split_of(F.col("url")) > 1), dim)
    host, path = url_parts(F.col("url"))
    held = labelled.filter((split_of(F.col("url")) == 0) & F.col("label").isNotNull()).select("label", host.alias("host"), path.alias("path"))
    held = with_features(held, "host", "path", dim).select("label", score(F.col("__f"), weights).alias("score"))
    steps = [i / 20 for i in range(1, 20)]
    cost = lambda t: F.when(F.col("label") == 1, (F.col("score") < t).cast("long")).otherwise(2 * (F.col("score") >= t).cast("long"))
    wrong = held.agg(*[F.sum(cost(t)).alias(f"r{i}") for i, t in enumerate(steps)]).first()
    return weights, min((wrong[i] or 0, abs(t - 0.5), -t) for i, t in enumerate(steps))[2] * -1


def filter_urls(
    df: DataFrame,
    labelled: DataFrame,
    url: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    dim: int = DIM,
    threshold: float | None = None,
) -> DataFrame:
    """df with host, path, rule, verdict and score, which replace columns of these names.

    A rule `host/path` fits its host and all subdomains if the path starts
    with the rule's; the longest wins. Without a rule, verdict is `block` where the model's score
    reaches the threshold (by default the one that fit() chooses). A null url has empty host and path, no rule and the bias's score; a url of any length is read whole.
    No shuffle: each row is judged on its own. An empty table gives no rows.
    """
    clash = ["host", "path", "rule", "verdict", "score"]
    kept = [c for c in df.columns if c not in clash]
    w, chosen = fit(labelled, dim)
    threshold = chosen if threshold is None else threshold
    host, path = url_parts(F.col(f"`{url}`"))
    rows = with_features(df.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path")), "host", "path", dim)
    known = F.array(*[F.struct(F.lit(r.partition("/")[0]).alias("h"), F.lit("/" + r.partition("/")[2]).alias("p"), F.lit(r).alias("rule"), F.lit(v).alias("v"))
                      for r, v in sorted(rules, key=lambda x: -len(x[0]))]) if rules else F.lit(None).cast("array<struct<h:string,p:string,rule:string,v:string>>")
    fits = lambda r: ((F.col("host") == r["h"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["h"]))) & F.startswith(F.col("path"), r["p"])
    rows = rows.withColumn("__r", F.get(F.filter(known, fits), F.lit(0))).withColumn("score", score(F.col("__f"), w))
    by_score = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return rows.select(*[F.col(f"`{c}`") for c in kept], "host", "path", F.col("__r.rule").alias("rule"), F.coalesce("__r.v", by_score).alias("verdict"), "score")


def default_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_urls(), "url string, label int")


def filter_pages(pages: DataFrame) -> DataFrame:
    """One row for every page, repeated ones too; a null url has empty host and path and no rule."""
    return filter_urls(pages.select("page_id", "url"), default_labels(pages.sparkSession)).select("page_id", "host", "path", "rule", "verdict", "score")
