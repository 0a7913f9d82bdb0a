"""Summaries of many rows: sketches by day, aggregates at many levels, sets with multiplicities."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import levels, sketches
from gleaner.plans.registry import query

_MONTH = "date_trunc('month', l_shipdate)"


def _days(t):
    """Sketches of each day's parts and prices, of each flag."""
    day = F.to_date("l_shipdate").alias("day")
    return sketches.sketched(t("lineitem"), [day, "l_returnflag"], F.col("l_partkey"), F.col("l_extendedprice"))


@query("SELECT l_returnflag, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n_rows, count(DISTINCT l_partkey) AS n_parts, true AS count_holds, true AS ranks_hold FROM lineitem GROUP BY 1, 2")
def sketched_months(t):
    """Months from the sketches of their days, held against the rows: whether the stated errors are kept."""
    month = F.date_format("day", "yyyy-MM").alias("month")
    shares = (0.25, 0.5, 0.75)
    told = sketches.read(sketches.merged(_days(t), ["l_returnflag", month]), shares)
    rows = t("lineitem").select("l_returnflag", F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_partkey", "l_extendedprice")
    met = rows.join(told.select("l_returnflag", "month", "n_things", "quantiles", F.col("n_rows").alias("n")), ["l_returnflag", "month"])
    below = [F.count_if(F.col("l_extendedprice") < F.col("quantiles")[i]).alias(f"below{i}") for i in range(3)]
    upto = [F.count_if(F.col("l_extendedprice") <= F.col("quantiles")[i]).alias(f"upto{i}") for i in range(3)]
    true = met.groupBy("l_returnflag", "month").agg(F.max("n").alias("n_rows"), F.count_distinct("l_partkey").alias("n_parts"), F.max("n_things").alias("n_things"), F.count("*").alias("k"), *below, *upto)
    held = F.lit(True)
    for i, s in enumerate(shares):
        held = held & (F.col(f"below{i}") <= (s + sketches.RANK_ERROR) * F.col("k")) & (F.col(f"upto{i}") >= (s - sketches.RANK_ERROR) * F.col("k"))
    near = F.abs(F.col("n_things") - F.col("n_parts")) <= F.greatest(F.lit(1.0), sketches.COUNT_ERROR * F.col("n_parts"))
    return true.select("l_returnflag", "month", "n_rows", "n_parts", near.alias("count_holds"), held.alias("ranks_hold"))


# Dimensions with nulls of their own: a line number of 3 and a status that is open have none.
_DIMS = "l_returnflag, CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_linestatus END AS status, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linenumber END AS line, CAST(l_quantity AS BIGINT) AS quantity, CASE WHEN l_linenumber <> 2 THEN CAST(l_quantity AS BIGINT) END AS part"
_NAMES = ["l_returnflag", "status", "line"]
_MEASURES = "sum(quantity) AS quantity, count(part) AS n_some, min(part) AS least, max(quantity) AS most, round(avg(part), 6) AS mean"


def _lines(t):
    return t("lineitem").selectExpr("l_returnflag", "CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_linestatus END AS status", "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linenumber END AS line", "CAST(l_quantity AS BIGINT) AS q", "CASE WHEN l_linenumber <> 2 THEN CAST(l_quantity AS BIGINT) END AS s")


def _levelled(t, sets):
    q, s = F.col("q"), F.col("s")
    out = levels.levels(_lines(t), _NAMES, sets, {"quantity": ("sum", q), "n_some": ("count", s), "least": ("min", s), "most": ("max", q), "mean": ("avg", s)})
    return out.withColumn("mean", F.round("mean", 6))


def _grouped(by):
    return f"SELECT l_returnflag, status, line, CAST(grouping_id(l_returnflag, status, line) AS BIGINT) AS grouping_id, {_MEASURES} FROM (SELECT {_DIMS} FROM lineitem) GROUP BY {by}"


@query(_grouped("CUBE (l_returnflag, status, line)"))
def lines_cube(t):
    return _levelled(t, levels.cube(_NAMES))


@query(_grouped("ROLLUP (l_returnflag, status, line)"))
def lines_rollup(t):
    return _levelled(t, levels.rollup(_NAMES))


@query(_grouped("GROUPING SETS ((l_returnflag, status), (line), (status), ())"))
def lines_grouping_sets(t):
    return _levelled(t, [("l_returnflag", "status"), ("line",), ("status",), ()])


@query(f"""SELECT line, sum(quantity) FILTER (WHERE l_returnflag = 'A') AS "A", sum(quantity) FILTER (WHERE l_returnflag = 'N') AS "N", sum(quantity) FILTER (WHERE l_returnflag = 'R') AS "R",
sum(quantity) FILTER (WHERE l_returnflag = 'none') AS "none" FROM (SELECT {_DIMS} FROM lineitem) GROUP BY line""")
def lines_pivot(t):
    return levels.pivoted(_lines(t), ["line"], "l_returnflag", ["A", "N", "R", "none"], "sum", F.col("q"))


# Sightings as two multisets: by whom they were, and by whom they would be if each user were the next one; some are by nobody.
_SEEN = "SELECT event_type, CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id % 40 END AS who FROM events"
_MOVED = "SELECT event_type, CASE WHEN user_id % 5 = 0 THEN NULL ELSE (user_id + 1) % 40 END AS who FROM events"


def _bags(t):
    who = [side.partition(",")[2].rpartition(" FROM")[0] for side in (_SEEN, _MOVED)]
    return [t("events").selectExpr("event_type", w) for w in who]


@query(f"{_SEEN} INTERSECT ALL {_MOVED}")
def seen_in_both(t):
    """Each sighting as often as both sides have it."""
    a, b = _bags(t)
    return a.intersectAll(b)


@query(f"{_SEEN} EXCEPT ALL {_MOVED}")
def seen_once_more(t):
    """Each sighting as many times as the one side has it more often than the other."""
    a, b = _bags(t)
    return a.exceptAll(b)
