"""Mixing sources to target weights: budgets flow down a tree, shortages go to siblings before ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.llm._store import cut, pick

#: Levels of the tree, from the root's children down.
TREE = ("domain", "lang", "source")
#: Domains of the query's and the pipeline's tree, by the number in a source's name, and their target weights (parameters).
DOMAINS = ("web", "books", "news", "forums")
DOMAIN_WEIGHTS = {"web": 4, "books": 3, "news": 2, "forums": 1}


def domain_of(source: Column) -> Column:
    """The domain of a source: the last number in its name, modulo the number of domains; ``web`` without one."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})[^0-9]*$", 1).try_cast("long")
    return F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), (F.coalesce(number, F.lit(0)) % len(DOMAINS) + 1).cast("int"))


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _fill(nodes: DataFrame, parent: list[str], child: str, budget: str) -> DataFrame:
    """Split each parent's budget among its children by weight, where no child takes more than its capacity.

    Children are ranked by capacity for one unit of weight. Those that are full at
    the final water level come first; the rest share what is left by weight. Whole
    tokens only: a child's amount is the step of the running total, rounded down.
    Needs columns cap and w; adds ``budget``.
    """
    order = [F.col("cap") / F.col("w"), F.col(child)]
    inside = Window.partitionBy(*parent)
    before = inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    nodes = nodes.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "w_left": F.sum("w").over(inside) - F.coalesce(F.sum("w").over(before), F.lit(0))})
    # full if the level that this and all later children would reach with it is at least its own
    full = F.col("cap") * F.col("w_left") <= (F.col("total") - F.col("cap_before")) * F.col("w")
    nodes = nodes.withColumn("full", full)
    rest = F.when(F.col("full"), F.lit(0)).otherwise(F.col("w"))
    nodes = nodes.withColumns({
        "w_rest": F.sum(rest).over(upto),
        "w_all": F.sum(rest).over(inside),
        "over": F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(inside),
    })
    down = lambda part: F.expr(f"CAST((over * ({part})) DIV w_all AS BIGINT)")
    share = F.when(F.col("full"), F.col("cap")).otherwise(down("w_rest") - down("w_rest - w"))
    return nodes.withColumn(budget, share).drop("cap_before", "w_left", "full", "w_rest", "w_all", "over", "total")


def budgets(leaves: DataFrame, target: int, weights: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """Token budgets of leaves (TREE columns, tokens, cap): the target flows down the tree.

    ``weights`` maps a level to positive whole weights of its names; other names
    weigh 1. A node that cannot hold its share passes the shortage to its siblings
    by weight; only when all siblings are full does it reach the ancestors, since
    a node's share is never more than its subtree's capacity.
    """
    weights = weights or {}
    for level, name in enumerate(TREE):
        table = weights.get(name, {})
        w = F.lit(1).cast("long")
        for key, value in sorted(table.items()):
            w = F.when(F.col(name) == key, F.lit(int(value)).cast("long")).otherwise(w)
        leaves = leaves.withColumn(f"w_{name}", w)
    out = None
    for level, name in enumerate(TREE):
        path = list(TREE[: level + 1])
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap"), F.first(f"w_{name}").alias("w"))
        if out is None:
            total = F.least(F.lit(int(target)), F.sum("cap").over(Window.partitionBy("root")))
            nodes = nodes.withColumn("root", F.lit(0)).withColumn("total", total)
            out = _fill(nodes, ["root"], name, "budget").select(*path, "budget")
        else:
            nodes = nodes.join(out.withColumnRenamed("budget", "total"), path[:-1])
            out = _fill(nodes, path[:-1], name, "budget").select(*path, "budget")
    return leaves.join(out, list(TREE)).select(*TREE, "tokens", "cap", "budget")


def mix(docs: DataFrame, target: float = 0.5, epochs: int = 2, seed: int = 3, weights: dict[str, dict[str, int]] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Select documents so that tokens follow the tree's weights.

    ``target`` is a share of all tokens in docs, ``epochs`` how often a document
    may be taken at most. A leaf with budget b takes whole epochs of its documents
    while they fit, and from the next epoch a prefix in that epoch's seeded order:
    documents while the tokens before them are less than what is left. So a leaf
    exceeds its budget by less than its last document.

    Returns row (its number), doc_id, domain, lang, source, n_tokens, copies (at
    least 1). A null lang or source is a branch of its own, named ``?``. Documents
    without tokens are never taken. Repeated rows are taken apart from each other;
    ties of the seeded hash go by row. Columns named in ``keep`` are returned as
    well, other extra columns are ignored. An empty table, or a target of 0,
    selects nothing.
    """
    spark = docs.sparkSession
    weights = {"domain": DOMAIN_WEIGHTS} if weights is None else weights
    rows = pick(docs, "doc_id", "text", "lang", "source", *keep)
    rows = rows.select(
        "doc_id", *keep, domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce("source", F.lit("?")).alias("source"), token_count(F.col("text")).alias("n_tokens"),
        F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), F.substring(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), 1, 8)).alias("name"),
    ).where("n_tokens > 0")
    rows = cut(rows, "mix-rows").withColumn("row", F.monotonically_increasing_id())
    leaves = rows.groupBy(*TREE).agg(F.sum("n_tokens").alias("tokens")).withColumn("cap", F.col("tokens") * int(epochs))
    leaves = cut(leaves, "mix-leaves")
    goal = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * target)
    plan = cut(budgets(leaves, goal, weights), "mix-plan")
    plan = plan.select(*TREE, F.expr("budget DIV tokens").alias("whole"), F.expr("budget % tokens").alias("left"))
    joined = rows.join(plan, list(TREE))
    # the order of the epoch that is taken in part; its first two hex digits deal a leaf into parts, so that no task holds a whole leaf
    digest = F.md5(F.concat(F.lit(f"{seed}/"), F.col("whole").cast("string"), F.lit("/"), F.col("name")).cast("binary"))
    part = F.conv(F.substring(digest, 1, 2), 16, 10).cast("int")
    joined = cut(joined.withColumns({"digest": digest, "part": part}), "mix-joined")
    sums = joined.groupBy(*TREE, "part", "whole", "left").agg(F.sum("n_tokens").alias("part_tokens"))
    sums = sums.withColumn("before", F.coalesce(F.sum("part_tokens").over(Window.partitionBy(*TREE).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # parts below the cut go in whole, the one at the cut is put in order, those above get nothing
    sums = sums.select(*TREE, "part", "before", (F.col("before") + F.col("part_tokens") <= F.col("left")).alias("below"), (F.col("before") < F.col("left")).alias("reached"))
    marked = joined.join(sums, [*TREE, "part"])
    at_cut = marked.where("reached and not below")
    run = F.col("before") + F.coalesce(F.sum("n_tokens").over(Window.partitionBy(*TREE).orderBy("digest", "row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at_cut = at_cut.withColumn("extra", (run < F.col("left")).cast("int"))
    out = marked.where("below or not reached").withColumn("extra", F.col("below").cast("int")).unionByName(at_cut)
    copies = (F.col("whole") + F.col("extra")).cast("int")
    return out.select("row", "doc_id", *keep, *TREE, "n_tokens", copies.alias("copies")).where("copies > 0")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that a mixture of half of all tokens takes: nulls, repeated rows and empty tables as mix() states."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), target=0.5, epochs=2).drop("row")


_LEVEL = """
{name}_n AS (SELECT {path}, sum(cap) AS cap, any_value(w_{name}) AS w FROM leaves GROUP BY ALL),
{name}_t AS ({totals}),
{name}_a AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS cap_before, sum(w) OVER p - coalesce(sum(w) OVER b, 0) AS w_left FROM {name}_t
  WINDOW p AS (PARTITION BY {parent}), b AS (PARTITION BY {parent} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_f AS (SELECT *, cap * w_left <= (total - cap_before) * w AS is_full FROM {name}_a),
{name}_s AS (SELECT *, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER u AS w_rest, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER p AS w_all, total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER p AS over_
  FROM {name}_f WINDOW p AS (PARTITION BY {parent}), u AS (PARTITION BY {parent} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{name}_b AS (SELECT {path}, CASE WHEN is_full THEN cap ELSE (over_ * w_rest) // w_all - (over_ * (w_rest - w)) // w_all END::BIGINT AS budget FROM {name}_s),"""


def _sql() -> str:
    weigh = "CASE domain " + " ".join(f"WHEN '{d}' THEN {w}" for d, w in DOMAIN_WEIGHTS.items()) + " ELSE 1 END"
    domains = "[" + ", ".join(f"'{d}'" for d in DOMAINS) + "]"
    levels = ""
    for i, name in enumerate(TREE):
        path = ", ".join(TREE[: i + 1])
        if i == 0:
            totals = "SELECT *, 0 AS root, least((SELECT goal FROM goal), sum(cap) OVER ())::BIGINT AS total FROM domain_n"
        else:
            up = TREE[i - 1]
            totals = f"SELECT n.*, b.budget AS total FROM {name}_n n JOIN {up}_b b USING ({', '.join(TREE[:i])})"
        levels += _LEVEL.format(name=name, path=path, parent="root" if i == 0 else ", ".join(TREE[:i]), totals=totals)
    return f"""
WITH rows_ AS (SELECT doc_id, {domains}[(coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})[^0-9]*$', 1) AS BIGINT), 0) % {len(DOMAINS)} + 1)::INT] AS domain,
  coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
  coalesce(doc_id::VARCHAR, '?') || '/' || substr(md5(coalesce(text, '')), 1, 8) AS name FROM documents),
docs AS (SELECT * FROM rows_ WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, 2 * sum(n_tokens)::BIGINT AS cap, {weigh} AS w_domain, 1 AS w_lang, 1 AS w_source FROM docs GROUP BY ALL),
goal AS (SELECT CAST(floor(sum(tokens) * 0.5) AS BIGINT) AS goal FROM leaves),{levels}
plan AS (SELECT domain, lang, source, budget // tokens AS whole, budget % tokens AS remainder FROM leaves JOIN source_b USING (domain, lang, source)),
ordered AS (SELECT doc_id, domain, lang, source, n_tokens, whole, remainder, md5('3/' || whole || '/' || name) AS digest FROM docs JOIN plan USING (domain, lang, source)),
run AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ordered)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, (whole + CASE WHEN before < remainder THEN 1 ELSE 0 END)::INT AS copies
FROM run WHERE whole + CASE WHEN before < remainder THEN 1 ELSE 0 END > 0
"""


SQL = _sql()
