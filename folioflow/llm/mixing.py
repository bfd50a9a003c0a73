"""Operator 3: mixing sources to target weights by hierarchical budgeting.

Domains, languages and sources form a tree. A budget of tokens goes down it:
at each node, children share by weight, none gets more than its subtree can
give (its tokens times `max_epochs`), and what one can't use goes to its
siblings, by weight again, before anything is left to the ancestors - which
have given the node no more than its subtree holds. Budgets are whole tokens,
rounded down. A leaf then takes the first tokens of its seeded epochs: each
epoch passes over the leaf's documents in the order of a hash of seed, epoch
and id; the document at the end is taken in part (`taken` of its `n_tokens`).

Everything is DataFrame functions. A hot leaf's running sums are made from
sums of hash ranges of about `range_rows` documents, so no task sorts a leaf.
Budgets are broadcast up to `broadcast_leaves` leaves, else joined with a salt.

Nulls in domain, lang or source form a node of their own, '(none)'; a null id
orders as ''. Documents without tokens are never taken. Rows that tie in the
order (same id) go by a hash of all columns; repeated rows are taken one by
one. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

NONE = "(none)"
LEAF = ["__domain", "__lang", "__source"]


@dataclass(frozen=True)
class Mix:
    """Target weights by node name (whole numbers over 0; 1 where not named) and how much to take."""

    domains: dict[str, int] = field(default_factory=dict)
    langs: dict[str, int] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)
    share_percent: int = 60  # of all tokens, where target_tokens isn't given
    target_tokens: int | None = None
    max_epochs: int = 2
    seed: int = 17
    range_rows: int = 4096
    broadcast_leaves: int = 1 << 20


def n_tokens(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The documents name no domain: sources are dealt to four by a hash."""
    return F.concat(F.lit("domain"), (F.conv(F.substring(F.md5(source.cast("binary")), 1, 4), 16, 10).cast("int") % 4).cast("string"))


def _weight(names: dict[str, int], c: str) -> Column:
    out = F.lit(1)
    for name, w in names.items():
        out = F.when(F.col(c) == name, F.lit(w)).otherwise(out)
    return out.cast("decimal(10,0)")


def share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes(parent..., name, weight, capacity, given to the parent as `budget`) with the node's own `budget`."""
    ratio = F.col("capacity").cast("double") / F.col("weight").cast("double")
    up = Window.partitionBy(*parent).orderBy(ratio, name).rowsBetween(Window.unboundedPreceding, -1)
    on = Window.partitionBy(*parent).orderBy(ratio, name).rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.partitionBy(*parent)
    big = lambda c: c.cast("decimal(20,0)")
    # those that can't use their share come first by capacity over weight
    left = F.col("budget") - F.coalesce(F.sum("capacity").over(up), F.lit(0))
    full = big(F.col("capacity")) * F.sum("weight").over(on).cast("decimal(15,0)") <= F.col("weight") * big(left)
    return (
        nodes.withColumn("full", full)
        .withColumn("rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(all_), F.lit(0)))
        .withColumn("of", F.sum(F.when(~F.col("full"), F.col("weight"))).over(all_))
        .withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("(weight * cast(rest as decimal(20,0))) div cast(of as decimal(15,0))")).cast("long"))
        .drop("full", "rest", "of")
    )


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves(LEAF, available, docs) with capacity and budget."""
    cap = leaves.withColumn("capacity", F.col("available") * mix.max_epochs)
    domains = cap.groupBy("__domain").agg(F.sum("capacity").alias("capacity"), F.sum("available").alias("available"))
    total = domains.agg(F.sum("capacity").alias("c"), F.sum("available").alias("a"))
    wanted = F.lit(mix.target_tokens).cast("long") if mix.target_tokens is not None else F.expr(f"(a * {mix.share_percent}) div 100")
    root = total.select(F.least("c", wanted).alias("budget"))  # one row
    domains = share(domains.drop("available").crossJoin(F.broadcast(root)).withColumn("weight", _weight(mix.domains, "__domain")).withColumn("root", F.lit(0)), ["root"], "__domain")
    langs = cap.groupBy("__domain", "__lang").agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(mix.langs, "__lang"))
    langs = share(langs.join(domains.select("__domain", "budget"), "__domain"), ["__domain"], "__lang")
    leaf = cap.withColumn("weight", _weight(mix.sources, "__source"))
    return share(leaf.join(langs.select("__domain", "__lang", "budget"), ["__domain", "__lang"]), ["__domain", "__lang"], "__source").drop("weight")


def mix_sources(docs: DataFrame, mix: Mix, domain: Column, tokens: Column) -> DataFrame:
    """docs' rows that are taken, once an epoch, with domain, epoch, n_tokens and taken (columns of these names give way)."""
    added = ("domain", "epoch", "n_tokens", "taken")
    base = docs.withColumns(
        {
            "__n": tokens,
            "__domain": F.coalesce(domain, F.lit(NONE)),
            "__lang": F.coalesce(F.col("lang").cast("string"), F.lit(NONE)),
            "__source": F.coalesce(F.col("source").cast("string"), F.lit(NONE)),
            "__tie": F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)),
        }
    ).drop(*added).filter("__n > 0")
    leaves = base.groupBy(*LEAF).agg(F.sum("__n").alias("available"), F.count("*").alias("docs"))
    budgets = leaf_budgets(leaves, mix).filter("budget > 0").select(*LEAF, F.col("available").alias("__available"), F.col("docs").alias("__docs"), F.col("budget").alias("__budget"))
    # a hot leaf's rows stay where they are: budgets go to all tasks, or, where leaves are very many, meet them by leaf and salt
    budgets = common.cut(budgets)
    if budgets.count() <= mix.broadcast_leaves:
        given = base.join(F.broadcast(budgets), LEAF)
    else:
        salted = budgets.withColumn("__salt", F.explode(F.expr("sequence(0L, 63L)")))
        given = base.withColumn("__salt", F.pmod(F.col("__tie"), F.lit(64))).join(salted, [*LEAF, "__salt"]).drop("__salt")
    passes = given.withColumn("__epoch", F.explode(F.expr("sequence(1, cast(ceil(__budget / __available) as int))")))
    key = F.md5(F.concat_ws(":", F.lit(mix.seed), "__epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    ranges = F.greatest(F.lit(1), F.expr(f"__docs div {mix.range_rows}"))
    placed = (
        passes.withColumn("__key", key)
        .withColumn("__room", F.least("__available", F.expr("__budget - (__epoch - 1) * __available")))
        .withColumn("__range", F.shiftright(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") * ranges, 32))
    )
    by = [*LEAF, "__epoch"]
    sums = placed.groupBy(*by, "__range").agg(F.sum("__n").alias("s"))
    before = sums.select(*by, "__range", (F.sum("s").over(Window.partitionBy(*by).orderBy("__range")) - F.col("s")).alias("__before"))
    order = Window.partitionBy(*by, "__range").orderBy("__key", "doc_id", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("__before") + F.sum("__n").over(order) - F.col("__n")
    return (
        placed.join(before, [*by, "__range"])
        .filter("__before < __room")
        .withColumn("__taken", F.least(F.col("__n"), F.col("__room") - start))
        .filter("__taken > 0")
        .select(*(f"`{c}`" for c in docs.columns if c not in added), F.col("__domain").alias("domain"), F.col("__epoch").alias("epoch"), F.col("__n").alias("n_tokens"), F.col("__taken").alias("taken"))
    )


#: Production weights of the registered query and of the pipeline.
PRODUCTION = Mix(domains={"domain0": 4, "domain1": 3, "domain2": 2}, langs={"en": 4, "de": 2, "fr": 2})


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # words are counted once; budgets, running sums and the result read the few columns that are left
    docs = common.cut(common.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", n_tokens(F.col("text")).alias("n")))
    return mix_sources(docs, PRODUCTION, domain_of(F.col("source")), F.col("n")).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline's last stage: the documents taken, with domain, epoch, n_tokens and taken."""
    return mix_sources(docs, PRODUCTION, domain_of(F.col("source")), n_tokens(F.col("text")))


_SHARE_SQL = """
{out} AS (
  SELECT {keys}, {carry} CASE WHEN capacity * w_on <= weight * (budget - coalesce(c_up, 0)) THEN capacity
    ELSE (weight * (budget - coalesce(sum(CASE WHEN capacity * w_on <= weight * (budget - coalesce(c_up, 0)) THEN capacity END) OVER (PARTITION BY {parent}), 0)))
      // sum(CASE WHEN NOT (capacity * w_on <= weight * (budget - coalesce(c_up, 0))) THEN weight END) OVER (PARTITION BY {parent}) END AS budget
  FROM (SELECT *, sum(capacity) OVER (PARTITION BY {parent} ORDER BY capacity::DOUBLE / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c_up,
               sum(weight) OVER (PARTITION BY {parent} ORDER BY capacity::DOUBLE / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_on
        FROM ({source})))
"""


def _case(names: dict[str, int], c: str) -> str:
    return "(CASE " + " ".join(f"WHEN {c} = '{k}' THEN {v}" for k, v in names.items()) + " ELSE 1 END)::HUGEINT" if names else "1::HUGEINT"


def op3_sql(mix: Mix = PRODUCTION) -> str:
    shares = [
        _SHARE_SQL.format(out="d3", keys="domain", carry="", parent="0", name="domain", source=f"SELECT domain, capacity, {_case(mix.domains, 'domain')} AS weight, (SELECT least(sum(available) * {mix.max_epochs}, sum(available) * {mix.share_percent} // 100) FROM leaves) AS budget FROM (SELECT domain, sum(available)::HUGEINT * {mix.max_epochs} AS capacity FROM leaves GROUP BY domain)"),
        _SHARE_SQL.format(out="l3", keys="domain, lang", carry="", parent="domain", name="lang", source=f"SELECT domain, lang, capacity, {_case(mix.langs, 'lang')} AS weight, budget FROM (SELECT domain, lang, sum(available)::HUGEINT * {mix.max_epochs} AS capacity FROM leaves GROUP BY ALL) JOIN d3 USING (domain)"),
        _SHARE_SQL.format(out="s3", keys="domain, lang, source", carry="available, ", parent="domain, lang", name="source", source=f"SELECT domain, lang, source, available::HUGEINT AS available, available::HUGEINT * {mix.max_epochs} AS capacity, {_case(mix.sources, 'source')} AS weight, budget FROM leaves JOIN l3 USING (domain, lang)"),
    ]
    return f"""
WITH sources AS (SELECT DISTINCT source, 'domain' || (('0x' || substr(md5(source), 1, 4))::INT % 4) AS domain FROM documents),
docs AS (SELECT doc_id, domain, lang, source, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS n FROM documents JOIN sources USING (source)),
leaves AS (SELECT domain, lang, source, sum(n) AS available FROM docs WHERE n > 0 GROUP BY ALL),
{",".join(shares)},
passes AS (
  SELECT d.*, epoch, least(available, budget - (epoch - 1) * available) AS room, md5('{mix.seed}:' || epoch || ':' || doc_id) AS k
  FROM docs d JOIN s3 USING (domain, lang, source), range(1, {mix.max_epochs} + 1) e(epoch)
  WHERE n > 0 AND (epoch - 1) * available < budget
)
SELECT doc_id, domain, lang, source, epoch::INT AS epoch, n AS n_tokens, least(n, room - before)::BIGINT AS taken
FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY domain, lang, source, epoch ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM passes)
WHERE before < room
"""
