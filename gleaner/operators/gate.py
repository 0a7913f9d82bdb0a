"""Whether documents spread their evidence over enough projects, and hold no forbidden dash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import base_name, bullet_label

MAX_PER_LABEL = 2
MIN_LABELS = 3
# Labels that name a topic and not a project; forbidden dashes.
TOPICS = (
    "agent ",
    "retrieval",
    "evaluation",
    "security review",
    "production debugging",
    "serverless",
    "reliability",
    "built with",
    "iterating",
    "wiring",
    "reverse engineering",
    "sicherheit",
    "evaluation und",
    "serverless unter",
    "tool-integrationen",
    "llm-orchestrierung",
)
DASHES = ("—", "–", "--")


def bullets(cvs: DataFrame) -> DataFrame:
    """(path, pos, bullet) of the experience sections, in order. cvs: path, sections with type and items (bullets)."""
    s = cvs.select("path", F.posexplode("sections").alias("__s", "s")).filter("s.type = 'experience'")
    i = s.select("path", "__s", F.posexplode("s.items").alias("__i", "item"))
    b = i.select("path", "__s", "__i", F.posexplode("item.bullets").alias("__b", "bullet"))
    return b.select("path", F.struct("__s", "__i", "__b").alias("pos"), "bullet")


def ungated_sections(cvs: DataFrame) -> DataFrame:
    """Sections that a document prints as experience and the gate does not read."""
    s = cvs.select("path", F.explode("sections").alias("s"))
    return s.filter("s.type NOT IN ('experience', 'skills')").groupBy("path").agg(F.count("*").alias("ungated_sections"))


def labels(bulleted: DataFrame) -> DataFrame:
    """(path, pos, label) of bullets that have one."""
    return bulleted.select("path", "pos", bullet_label(F.col("bullet")).alias("label")).filter("label <> ''")


def frequency(labelled: DataFrame, by: Sequence[str] = ("path",)) -> DataFrame:
    return labelled.groupBy(*by, "label").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def is_topic(label: Column, topics: Sequence[str] = TOPICS) -> Column:
    return label.rlike(f"(?iu)^({'|'.join(topics)})")


def report_order(counted: DataFrame, by: Sequence[str] = ("path",)) -> DataFrame:
    """Labels by count, ties as they first appear."""
    return counted.orderBy(*by, F.desc("n"), "first_pos")


def problems(paths: DataFrame, labelled: DataFrame, most: int = MAX_PER_LABEL, least: int = MIN_LABELS, topics: Sequence[str] = TOPICS) -> DataFrame:
    """(path, rule, problem) of documents. A document without labels has that problem alone, told with its full path; others are
    told with their folder's name."""
    n = frequency(labelled)
    over = F.when(F.col("n") > most, F.struct("label", "n"))
    topic = F.when(is_topic(F.col("label"), topics), F.col("label"))
    per = n.groupBy("path").agg(F.count("*").alias("k"), F.array_sort(F.collect_list(over)).alias("over"), F.array_sort(F.collect_list(topic)).alias("topics"))
    each = paths.select("path").distinct().join(per, "path", "full")
    folder = base_name(F.regexp_replace("path", "/[^/]*$", ""))
    # The wordings of the problems.
    tell = lambda rule, *parts: F.struct(F.lit(rule).alias("rule"), F.concat(*parts).alias("problem"))
    started = lambda rule, *parts: tell(rule, folder, F.lit(": "), *parts)
    found = F.when(F.col("k").isNull(), F.array(tell("no_labels", F.col("path"), F.lit(": no labelled bullets found")))).otherwise(
        F.concat(
            F.transform("over", lambda x: started("over_limit", F.lit("'"), x["label"], F.lit("' appears "), x["n"].cast("string"), F.lit(f" times, limit is {most}"))),
            F.filter(
                F.array(
                    F.when(F.col("k") < least, started("too_few", F.lit("only "), F.col("k").cast("string"), F.lit(f" distinct projects, minimum is {least}"))),
                    F.when(F.size("topics") > 0, started("topics", F.lit("topic labels, not project names: "), F.array_join("topics", ", "))),
                ),
                lambda x: x.isNotNull(),
            ),
        )
    )
    return each.select("path", F.explode(found).alias("f")).select("path", "f.rule", "f.problem")


def missing_paths(expected: DataFrame, found: DataFrame) -> DataFrame:
    return expected.join(found.select("path"), "path", "left_anti").select("path", F.lit("not_found").alias("rule"), F.concat("path", F.lit(": not found")).alias("problem"))


def verdict(found: DataFrame) -> DataFrame:
    """One row: whether there is no problem, and how many there are."""
    return found.agg((F.count("*") == 0).alias("ok"), F.count("*").alias("n_problems"))


def forbidden_dash(payload: Column) -> Column:
    """The first forbidden dash, in the order of the list, anywhere in a serialised payload, keys included; else null."""
    out = F.when(F.lit(False), F.lit(""))
    for d in DASHES:
        out = out.when(F.contains(payload, F.lit(d)), F.lit(d))
    return out
