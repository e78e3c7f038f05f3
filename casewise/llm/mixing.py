"""Mixing sources to target weights.

A corpus is a tree of domains, languages and sources with integer target weights. A budget of tokens
goes down the tree: at each node the children share it by weight, none beyond its capacity (tokens
times epochs of all below it), and what a child cannot use goes to its siblings by weight. As a node
never gets more than it can hold, a shortage is made up among siblings first, and only what they
cannot hold either goes to the siblings of the node above. A child of weight 0 gets nothing.

A leaf with budget b and t tokens is taken whole b // t times, once per epoch, and the next epoch
gives the longest prefix whose tokens fit the rest. The order within an epoch is by
md5(seed:epoch:doc_id), so every epoch has an order of its own. The prefix needs no sort of a leaf:
tokens are summed by the first digits of the key, and only the digits at which the budget ends are
looked at row by row. Documents of equal key (repeated ids) are taken or left together.

Tokens are words ``[^\\x20\\x09-\\x0D]+``; null and empty texts have none and take part in the order with
size 0. A null language, source or domain is the same leaf as an empty one; a null id orders as an
empty one. An empty table gives no rows. Other columns pass through ``mixed_documents`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewise.llm.common import Workspace, prepare
from casewise.session import Scratch

LEVELS = ["domain", "lang", "source"]
# Digits of the key by which tokens are summed first.
DIGITS = 3
WORD = r"[^ \t-\r]+"

# The mixture of the query and of the pipeline: weights by level and name, 1 where none is given.
DOMAIN_WEIGHTS = {"web": 40, "books": 35, "forums": 25}
LANGUAGE_WEIGHTS = {"en": 50, "de": 20, "fr": 20, "es": 10}
SOURCE_WEIGHTS: dict[str, int] = {}
BUDGET_PERCENT = 80
EPOCHS = 2
SEED = 11


def domain_of(source: Column) -> Column:
    """The domain of a source as the test tables name them: the largest source is the web, the others are books or forums by number.

    Another corpus gives ``mix`` and ``mixed_documents`` a column expression of its own.
    """
    number = F.expr("try_cast(substring(source, 4) AS int)")
    return F.when(source == "src0", "web").when(number % 2 == 0, "books").otherwise("forums")


def weight_of(name: Column, weights: dict[str, int]) -> Column:
    """The weight given for a name, 1 for any other."""
    out = F.lit(None).cast("long")
    for key, weight in weights.items():
        out = F.coalesce(out, F.when(name == key, F.lit(weight).cast("long")))
    return F.coalesce(out, F.lit(1).cast("long"))


def share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Give each child its ``budget`` out of its parent's ``total``; children have ``weight`` and ``capacity``.

    Children are filled in the order of capacity per weight: the first ones to run full leave more
    to the rest.
    """
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(1))
    order = group.orderBy("ratio", name)
    counted = children.where("weight > 0").withColumn("ratio", F.col("capacity").cast("double") / F.col("weight"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        counted.withColumn("left", F.col("total") - (F.sum("capacity").over(upto) - F.col("capacity")))
        .withColumn("weights", F.sum("weight").over(group) - (F.sum("weight").over(upto) - F.col("weight")))
        .withColumn("place", F.row_number().over(order))
        .withColumn("fair", F.floor(F.col("left").cast("double") * F.col("weight") / F.col("weights")))
    )
    open_ = placed.withColumn("at", F.min(F.when(F.col("capacity") > F.col("fair"), F.col("place"))).over(group))
    here = F.col("place") == F.col("at")
    rest = open_.withColumn("rest", F.max(F.when(here, F.col("left"))).over(group)).withColumn(
        "rest_weights", F.max(F.when(here, F.col("weights"))).over(group)
    )
    fair = F.floor(F.col("rest").cast("double") * F.col("weight") / F.col("rest_weights"))
    budget = F.when(F.col("at").isNull() | (F.col("place") < F.col("at")), F.col("capacity")).otherwise(fair)
    return rest.select(*parent, name, budget.cast("long").alias("budget"))


def leaf_budgets(leaves: DataFrame, weights: list[dict[str, int]], budget: int, epochs: int) -> DataFrame:
    """domain, lang, source, size (tokens), budget of each leaf; ``leaves`` has domain, lang, source, size."""
    above = None
    # A leaf with a weight of 0 on its path takes nothing and adds to no capacity.
    open_ = F.lit(True)
    for depth, name in enumerate(LEVELS):
        open_ &= weight_of(F.col(name), weights[depth]) > 0
    usable = leaves.where(open_)
    for depth, name in enumerate(LEVELS):
        parent = LEVELS[:depth]
        nodes = usable.groupBy(*parent, name).agg((F.sum("size") * epochs).alias("capacity"))
        nodes = nodes.withColumn("weight", weight_of(F.col(name), weights[depth]))
        if above is None:
            # Never more than all can hold: weightless children count for nothing.
            most = nodes.where("weight > 0").agg(F.coalesce(F.sum("capacity"), F.lit(0)).alias("most"))
            nodes = nodes.crossJoin(F.broadcast(most)).withColumn("total", F.least(F.lit(budget), F.col("most")))
        else:
            nodes = nodes.join(above.withColumnRenamed("budget", "total"), parent)
        above = share(nodes, parent, name)
    return leaves.join(above, LEVELS).select(*LEVELS, "size", "budget")


def _key(epoch: Column, doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def leaf_cuts(
    docs: DataFrame, weights: list[dict[str, int]], budget_percent: int, epochs: int, seed: int, domain: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(narrow rows, cuts): the leaf, id and tokens of each document; and for each leaf the whole epochs and the last key taken after them."""
    prepare(docs.sparkSession)
    named = [
        F.coalesce(domain_of(F.col("source")) if domain is None else domain, F.lit("")).alias("domain"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
    ]
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens")
    narrow = Scratch(docs.select("doc_id", words, *named), "tokens").frame
    work = Workspace()
    leaves = work.keep(narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("size")), "leaves")
    total = leaves.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shares = leaf_budgets(leaves, weights, total * budget_percent // 100, epochs)
    whole = F.when(F.col("size") > 0, F.expr("budget div size")).otherwise(F.lit(0)).alias("whole")
    plan = work.keep(
        shares.select(*LEVELS, "size", "budget", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("size")),
        "budgets",
    )
    keyed = narrow.join(plan, LEVELS).where("rest > 0").withColumn("key", _key(F.col("whole"), F.col("doc_id"), seed))
    digits = F.substring("key", 1, DIGITS)
    sums = keyed.groupBy(*LEVELS, "rest", digits.alias("digits")).agg(F.sum("tokens").alias("tokens"))
    running = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("digits"))
    ends = (
        sums.withColumn("upto", running)
        .where(F.col("upto") > F.col("rest"))
        .groupBy(*LEVELS)
        .agg(F.min_by(F.struct("digits", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("room")), "digits").alias("end"))
        .select(*LEVELS, "end.*")
    )
    last = (
        keyed.join(ends, LEVELS)
        .where(digits == F.col("digits"))
        .withColumn("upto", F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
        .where(F.col("upto") <= F.col("room"))
        .groupBy(*LEVELS)
        .agg(F.max("key").alias("last"))
    )
    # Keys up to the digits before, or up to the last one that fits.
    cuts = (
        plan.join(ends, LEVELS, "left")
        .join(last, LEVELS, "left")
        .select(*LEVELS, "whole", F.when(F.col("rest") > 0, F.coalesce("last", "digits")).alias("last"))
    )
    written = Scratch(cuts, "cuts").frame
    work.clear()
    return narrow, written


def _epochs_taken(seed: int, doc_id: Column) -> Column:
    """Array of the epochs in which a row is taken."""
    partial = F.col("last").isNotNull() & (_key(F.col("whole"), doc_id, seed) <= F.col("last"))
    count = F.col("whole") + F.when(partial, 1).otherwise(0)
    return F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>"))


def mix(
    docs: DataFrame,
    weights: list[dict[str, int]] | None = None,
    budget_percent: int = BUDGET_PERCENT,
    epochs: int = EPOCHS,
    seed: int = SEED,
    domain: Column | None = None,
) -> DataFrame:
    """doc_id, domain, lang, source, tokens and epoch of every document taken, once per epoch; the budget is a share of all tokens.

    ``domain`` is a column expression over ``docs``, by default that of the test tables (``domain_of``).
    """
    weights = weights or [DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS, SOURCE_WEIGHTS]
    narrow, cuts = leaf_cuts(docs, weights, budget_percent, epochs, seed, domain)
    taken = narrow.join(cuts, LEVELS).withColumn("epoch", F.explode(_epochs_taken(seed, F.col("doc_id"))))
    return taken.select("doc_id", *LEVELS, "tokens", "epoch")


def mixed_documents(
    docs: DataFrame,
    weights: list[dict[str, int]] | None = None,
    budget_percent: int = BUDGET_PERCENT,
    epochs: int = 1,
    seed: int = SEED,
    domain: Column | None = None,
) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, each as often as it has epochs, with all their columns; ``domain`` as for ``mix``."""
    weights = weights or [DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS, SOURCE_WEIGHTS]
    _, cuts = leaf_cuts(docs, weights, budget_percent, epochs, seed, domain)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.coalesce(domain_of(F.col("source")) if domain is None else domain, F.lit("")).alias("domain"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
    )
    taken = rows.join(cuts, LEVELS).withColumn("epoch", F.explode(_epochs_taken(seed, F.col("doc.doc_id"))))
    return taken.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END" if weights else "1"


def _share_sql(nodes: str, parent: str, name: str) -> str:
    part = f"PARTITION BY {parent}" if parent else ""
    head = f"{parent}, " if parent else ""
    upto = f"OVER ({part} ORDER BY capacity::DOUBLE / weight, {name} ROWS UNBOUNDED PRECEDING)"
    return f"""
    SELECT {head}{name}, CASE WHEN spot IS NULL OR place < spot THEN capacity
      ELSE floor(max(CASE WHEN place = spot THEN remaining END) OVER ({part})::DOUBLE * weight
        / max(CASE WHEN place = spot THEN weights END) OVER ({part}))::BIGINT END AS budget
    FROM (SELECT *, min(CASE WHEN capacity > floor(remaining::DOUBLE * weight / weights) THEN place END) OVER ({part}) AS spot
      FROM (SELECT *, (total - (sum(capacity) {upto} - capacity))::BIGINT AS remaining,
          (sum(weight) OVER ({part}) - (sum(weight) {upto} - weight))::BIGINT AS weights, row_number() {upto.replace(' ROWS UNBOUNDED PRECEDING', '')} AS place
        FROM ({nodes}) WHERE weight > 0))"""


ORACLE = f"""
WITH narrow AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens,
    CASE WHEN source = 'src0' THEN 'web' WHEN TRY_CAST(substring(source, 4) AS INT) % 2 = 0 THEN 'books' ELSE 'forums' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS size FROM narrow GROUP BY ALL),
d AS ({_share_sql(f'''SELECT *, least(most, all_tokens * {BUDGET_PERCENT} // 100)::BIGINT AS total FROM (
    SELECT *, sum(capacity) OVER () AS most FROM (SELECT domain, (sum(size) * {EPOCHS})::BIGINT AS capacity,
      {_case("domain", DOMAIN_WEIGHTS)} AS weight FROM leaves GROUP BY domain)), (SELECT sum(size) AS all_tokens FROM leaves)''', '', 'domain')}),
l AS ({_share_sql(f'''SELECT n.*, d.budget AS total FROM (SELECT domain, lang, (sum(size) * {EPOCHS})::BIGINT AS capacity,
      {_case("lang", LANGUAGE_WEIGHTS)} AS weight FROM leaves GROUP BY domain, lang) n JOIN d USING (domain)''', 'domain', 'lang')}),
s AS ({_share_sql(f'''SELECT n.*, l.budget AS total FROM (SELECT domain, lang, source, (sum(size) * {EPOCHS})::BIGINT AS capacity,
      {_case("source", SOURCE_WEIGHTS)} AS weight FROM leaves GROUP BY domain, lang, source) n JOIN l USING (domain, lang)''', 'domain, lang', 'source')}),
plan AS (SELECT s.*, size, CASE WHEN size > 0 THEN budget // size ELSE 0 END AS whole FROM s JOIN leaves USING (domain, lang, source)),
whole_epochs AS (
  SELECT doc_id, domain, lang, source, tokens, unnest(range(whole)) AS epoch FROM narrow JOIN plan USING (domain, lang, source)),
last_epoch AS (
  SELECT doc_id, domain, lang, source, tokens, whole AS epoch FROM (
    SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE UNBOUNDED PRECEDING) AS upto
    FROM (SELECT *, md5(concat('{SEED}:', whole, ':', coalesce(doc_id::VARCHAR, ''))) AS key FROM narrow JOIN plan USING (domain, lang, source)))
  WHERE budget - whole * size > 0 AND upto <= budget - whole * size)
SELECT doc_id, domain, lang, source, tokens, epoch::BIGINT AS epoch FROM whole_epochs
UNION ALL SELECT doc_id, domain, lang, source, tokens, epoch::BIGINT FROM last_epoch
"""
