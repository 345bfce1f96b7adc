"""Mixing sources to target weights by hierarchical budgeting.

The corpus is a tree, root - domain - language - source. A node's capacity is its tokens times the epochs
that a leaf may be repeated. A token budget goes down the tree: at each node the budget fills its children
in proportion to their weights, none beyond its capacity; what a child cannot take goes to its siblings,
and only what a whole subtree cannot take goes to the siblings of its root. Filling is exact in integers:
with children sorted by capacity / weight, running sums give the one level at which the budget is used up.

Each leaf then takes its budget from seeded epochs, each a permutation of its documents by a hash of seed,
epoch and id: all documents for every whole epoch, and of the next epoch those before the point where the
running sum of tokens passes what is left.

Scale: only sums per leaf and per (leaf, hash bucket) are shuffled and sorted. Running sums over documents
are taken in the one bucket of a leaf where the budget ends, over one row for each place in the permutation;
what comes out is one row per leaf, its epochs and the last hash that is in. So whether a document is taken
is told by its own row and its leaf's, which are broadcast where they are few, and a source with a third
of all rows is spread over as many tasks as others.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textspark.llm.common import WORD, cut, own, unused

LEVELS = ("domain", "lang", "source")
#: Hex digits of the permutation hash that make a bucket: 4,096 buckets in a leaf.
BUCKET_DIGITS = 3
#: Leaves' rows are broadcast up to this many (some 200 bytes each), else joined by shuffle.
MOST_BROADCAST = 100_000


def _weight(column: str, weights: Mapping[str, int] | None, default: int) -> Column:
    out = F.lit(default)
    for name, weight in (weights or {}).items():
        out = F.when(F.col(column) == name, F.lit(weight)).otherwise(out)
    return out.cast("bigint")


def fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """nodes (parents, name, capacity, weight, parent_budget) with ``budget``, the water-filling of each
    parent's budget over its children."""
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight"))
    by = Window.partitionBy(*(parents or [F.lit(0)]))
    rising = by.orderBy(ratio.asc_nulls_last(), name)
    before = F.coalesce(F.sum("_c").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = nodes.withColumn("_c", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0).cast("bigint"))
    rows = rows.withColumns({"_before": before, "_left": left, "_rank": F.row_number().over(rising)})
    short = (F.col("weight") > 0) & (F.col("_c") * F.col("_left") <= (F.col("parent_budget") - F.col("_before")) * F.col("weight"))
    rows = rows.withColumn("_short", short)  # a prefix of the siblings in this order takes its whole capacity
    first = F.min(F.when(~F.col("_short") & (F.col("weight") > 0), F.struct("_rank", "_before", "_left"))).over(by)
    rows = rows.withColumn("_level", first)
    share = F.expr("(parent_budget - _level._before) * weight div _level._left")
    budget = F.when(F.col("weight") <= 0, 0).when(F.col("_level").isNull() | (F.col("_rank") < F.col("_level._rank")), F.col("_c")).otherwise(F.least(F.col("_c"), share))
    return rows.withColumn("budget", budget.cast("bigint")).drop("_c", "_before", "_left", "_rank", "_short", "_level")


def leaf_budgets(leaves: DataFrame, budget: DataFrame, weights: Mapping[str, Mapping[str, int]], max_epochs: int) -> DataFrame:
    """leaves (LEVELS, tokens) with the ``budget`` of each; ``budget`` is one row of one column, ``total``."""
    rows = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    given: DataFrame | None = None
    for depth, level in enumerate(LEVELS, 1):
        path, parents = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        nodes = rows.groupBy(*path).agg(F.sum("capacity").cast("bigint").alias("capacity")).withColumn("weight", _weight(level, weights.get(level), 1))
        above = nodes.join(F.broadcast(budget.withColumnRenamed("total", "parent_budget"))) if given is None else nodes.join(given.withColumnRenamed("budget", "parent_budget"), parents)
        given = fill(above, parents, level).select(*path, "budget")
    return rows.select(*LEVELS, "tokens").join(given, list(LEVELS))


def _name(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _described(domain: Column, id_col: str, text_col: str) -> dict[str, Column]:
    return {
        "domain": _name(domain), "lang": _name(F.col("lang")), "source": _name(F.col("source")), "name": _name(own(id_col)),
        "n_tokens": F.coalesce(F.regexp_count(own(text_col), F.lit(WORD)), F.lit(0)).cast("bigint"),
    }


def _small(leaves: DataFrame) -> DataFrame:
    """leaves, a written table with one row per leaf, marked for broadcast if they are few."""
    return F.broadcast(leaves) if leaves.count() <= MOST_BROADCAST else leaves


def _order(seed: int, name: Column) -> Column:
    """A document's place in the permutation of the epoch that is filled in part."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), name).cast("binary"))


def leaf_plan(rows: DataFrame, weights: Mapping[str, Mapping[str, int]] | None, budget_percent: int, max_epochs: int, seed: int) -> DataFrame:
    """(LEVELS, epochs, last) of each leaf of rows (LEVELS, name, n_tokens): how often all of its documents are
    taken, and up to which hash they are taken once more (null: all that have tokens; '': none)."""
    if max_epochs < 1 or budget_percent < 0:
        raise ValueError("max_epochs is at least 1, budget_percent at least 0")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    total = leaves.agg(F.expr(f"coalesce(sum(tokens), 0) * {budget_percent} div 100").alias("total"))
    budgets = leaf_budgets(leaves, total, weights or {}, max_epochs).select(
        *LEVELS, F.expr("if(tokens > 0, budget div tokens, 0)").alias("epochs"), F.expr("if(tokens > 0, budget % tokens, 0)").alias("rest")
    )
    budgets = cut(budgets, "budgets")
    placed = rows.join(_small(budgets), list(LEVELS)).withColumn("_order", _order(seed, F.col("name"))).withColumn("_bucket", F.substring("_order", 1, BUCKET_DIGITS))
    sums = placed.groupBy(*LEVELS, "_bucket", "rest").agg(F.sum("n_tokens").alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy(*LEVELS).orderBy("_bucket"))  # at most 4,096 rows a leaf
    edges = sums.withColumn("_upto", upto).filter("_upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("_bucket", (F.col("_upto") - F.col("_sum")).alias("_before"))).alias("_edge"))
    edges = cut(edges, "edges")
    at_edge = placed.join(_small(edges), list(LEVELS)).filter(F.col("_bucket") == F.col("_edge._bucket"))
    places = at_edge.groupBy(*LEVELS, "_order", "rest", "_edge").agg(F.sum("n_tokens").alias("n_tokens"))  # equal ids count together
    running = F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("_order"))
    inside = places.withColumn("_in", F.col("_edge._before") + running <= F.col("rest")).filter("_in").groupBy(*LEVELS).agg(F.max("_order").alias("_inside"))
    last = F.when(F.col("_edge").isNotNull(), F.coalesce("_inside", F.col("_edge._bucket")))  # the bare bucket comes before its hashes
    plan = budgets.join(edges, list(LEVELS), "left").join(inside, list(LEVELS), "left")
    return cut(plan.select(*LEVELS, "epochs", last.alias("last")), "leaves")


def _copies(seed: int, name: Column, n_tokens: Column) -> Column:
    once_more = F.col("last").isNull() | (_order(seed, name) <= F.col("last"))
    return F.when(n_tokens > 0, F.col("epochs") + once_more.cast("bigint")).otherwise(0).cast("bigint")


def mix(
    docs: DataFrame,
    domain: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: Mapping[str, Mapping[str, int]] | None = None,
    budget_percent: int = 60,
    max_epochs: int = 2,
    seed: int = 1,
) -> DataFrame:
    """One row per input row: id, domain, lang, source, n_tokens, copies (how often the mix holds it).

    The budget is budget_percent of all tokens; tokens are words. Weights are positive integers by level and
    name, 1 where none is given; a name with weight 0 gets nothing. Null domains, languages and sources are
    the name ''. Documents without a word, null texts included, have no copies; a long one counts whole and is in
    or out whole. Rows of a leaf that share an id share their place in its permutation and are in or out
    together, a null id counting as ''; in other leaves they have places of their own. An empty table gives
    an empty result with the same columns; other columns of the input, whatever their names, are not looked at."""
    rows = cut(docs.select(own(id_col).alias("_id"), *(c.alias(n) for n, c in _described(domain, id_col, text_col).items())), "mix")
    plan = leaf_plan(rows, weights, budget_percent, max_epochs, seed)
    both = rows.join(_small(plan), list(LEVELS))
    return both.select(F.col("_id").alias(id_col), *LEVELS, "n_tokens", _copies(seed, F.col("name"), F.col("n_tokens")).alias("copies"))


def mixed_rows(docs: DataFrame, domain: Column, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, **settings) -> DataFrame:
    """The rows of docs, all columns unchanged, each as often as mix() says. Each row's number is told on the row
    itself, so that rows of one id in several leaves, and null ids, are not mixed up. Columns may have any names."""
    described = _described(domain, id_col, text_col)
    rows = docs.select(*(c.alias(n) for n, c in described.items()))
    defaults = {"weights": None, "budget_percent": 60, "max_epochs": 2} | settings
    plan = leaf_plan(cut(rows, "mix"), defaults["weights"], defaults["budget_percent"], defaults["max_epochs"], seed)
    (row,) = unused([*described, "epochs", "last"], "_row")
    whole = docs.select(F.struct(*(own(c).alias(f"c{k}") for k, c in enumerate(docs.columns))).alias(row), *(c.alias(n) for n, c in described.items()))
    taken = whole.join(_small(plan), list(LEVELS)).withColumn("copies", _copies(seed, F.col("name"), F.col("n_tokens"))).filter("copies > 0")
    taken = taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return taken.select(*(F.col(f"{row}.c{k}").alias(c) for k, c in enumerate(docs.columns)))


def oracle(weights: Mapping[str, Mapping[str, int]], domain_sql: str, budget_percent: int, max_epochs: int, seed: int) -> str:
    """The same mix in DuckDB SQL over ``documents``."""

    def weight(level: str) -> str:
        cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.get(level, {}).items())
        return f"CASE {level} {cases} ELSE 1 END" if cases else "1"

    def level(depth: int) -> str:
        path, parents, name = ", ".join(LEVELS[:depth]), LEVELS[: depth - 1], LEVELS[depth - 1]
        by = "PARTITION BY " + (", ".join(parents) or "0")
        source = "root" if depth == 1 else f"b{depth - 1}"
        joined = "n CROSS JOIN root" if depth == 1 else f"n JOIN (SELECT {', '.join(parents)}, budget AS parent_budget FROM {source}) p USING ({', '.join(parents)})"
        return f"""
        b{depth} AS (
          WITH n AS (SELECT {path}, sum(capacity)::BIGINT AS capacity, ({weight(name)})::BIGINT AS weight FROM leaves GROUP BY {path}),
          o AS (SELECT *, row_number() OVER ({by} ORDER BY capacity / weight, {name}) AS rnk,
              coalesce(sum(capacity) OVER ({by} ORDER BY capacity / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
              sum(weight) OVER ({by} ORDER BY capacity / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM {joined}),
          f AS (SELECT *, min(CASE WHEN capacity * left_w > (parent_budget - before) * weight THEN rnk END) OVER ({by}) AS stop FROM o),
          g AS (SELECT *, max(CASE WHEN rnk = stop THEN before END) OVER ({by}) AS s_before, max(CASE WHEN rnk = stop THEN left_w END) OVER ({by}) AS s_left FROM f)
          SELECT {path}, (CASE WHEN stop IS NULL OR rnk < stop THEN capacity ELSE least(capacity, (parent_budget - s_before) * weight // s_left) END)::BIGINT AS budget FROM g)"""

    return f"""
        WITH rows AS (SELECT doc_id, ({domain_sql}) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
              coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
        leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {max_epochs})::BIGINT AS capacity FROM rows GROUP BY ALL),
        root AS (SELECT (coalesce(sum(tokens), 0) * {budget_percent} // 100)::BIGINT AS parent_budget FROM leaves),
        {level(1)}, {level(2)}, {level(3)},
        plan AS (SELECT l.domain, l.lang, l.source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest
              FROM leaves l JOIN b3 USING (domain, lang, source)),
        placed AS (SELECT r.*, epochs, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || epochs || ':' || coalesce(doc_id::VARCHAR, ''))) AS upto
              FROM rows r JOIN plan USING (domain, lang, source))
        SELECT doc_id, domain, lang, source, n_tokens, (CASE WHEN n_tokens > 0 THEN epochs + (upto <= rest)::BIGINT ELSE 0 END)::BIGINT AS copies FROM placed
    """
