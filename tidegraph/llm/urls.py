"""URL filtering: explicit rules, and association rules mined for the rest.

Explicit rules name a host and a path prefix and hold for the host and its
subdomains; the longest fitting one decides. The URLs they decide are labels, and
Spark's FP-growth mines from them which combinations of URL tokens go with
"block". Rules under the least support or confidence are dropped, and so is a
rule that adds tokens to a shorter one without being more certain. The rest form
an inverted index from token to rule; a URL is blocked if it has all tokens of a
rule, and allowed otherwise.

Tokens are the labels of the host, pairs of its neighbouring ones, the words of
the path and the names in the query. Numbers are one token: they name single
pages. Tokens that stand in the same labelled URLs are mined as one item, so that a
long URL that many rows repeat is a few items and not a power set; elsewhere any of
these tokens stands for the item, as any of them alone would make the same rules.

Equal baskets are one row with a weight until FP-growth asks for rows; a weight is
dealt to all tasks in pieces.

Defined cases: a null URL, or one without ``://``, has an empty host and path and
no tokens; no rule fits it and it is allowed. Repeated rows count as often as they
occur. Without labels nothing is mined and the rest is allowed. An empty table
gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.scratch import Scratch

ALLOW, BLOCK = "allow", "block"
RULES = (  # host, path, verdict
    ("org", "/", ALLOW),
    ("example.org", "/es/", BLOCK),
    ("example.org", "/en/1", BLOCK),
    ("com", "/fr/", ALLOW),
    ("com", "/de/", BLOCK),
)
LEAST_SUPPORT, LEAST_CONFIDENCE = 0.005, 0.9
BROADCAST_RULES = 20_000
PIECE = 10_000  # rows made of one basket at once
_LABEL = "verdict="


# ---- parts of a URL -------------------------------------------------------


def host(url: Column) -> Column:
    authority = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    lower = F.translate(authority, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    inner = F.concat_ws(".", labels)
    parts = F.split(inner, r"\.")
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda i: F.concat(F.lit("h2="), F.get(parts, i - 1), F.lit("."), F.get(parts, i)))
    words = F.filter(F.split(path, r"[^\p{L}\p{N}]+"), lambda x: x != "")
    number = lambda x: F.when(x.rlike(r"^\d+$"), F.lit("0")).otherwise(x)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.filter(
        F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    return F.array_distinct(F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("h="), x)),
        F.when(F.size(parts) > 1, pairs).otherwise(F.array().cast("array<string>")),
        F.transform(words, lambda x: F.concat(F.lit("p="), number(x))),
        F.transform(names, lambda x: F.concat(F.lit("q="), x)),
    ))


# ---- explicit rules -------------------------------------------------------


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as ``host + path``, or null."""
    found = F.lit(None).cast("string")
    for name, prefix, _ in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        found = F.when(fits, name + prefix).otherwise(found)
    return found


def rule_verdict(rule: Column, rules=RULES) -> Column:
    verdict = F.lit(None).cast("string")
    for name, prefix, says in rules:
        verdict = F.when(rule == name + prefix, says).otherwise(verdict)
    return verdict


# ---- mined rules ----------------------------------------------------------


def _item_tokens(labelled: DataFrame, least: float) -> DataFrame:
    """``item, token`` of the tokens on labelled rows of a weight of ``least`` in all;
    those of exactly the same rows are one item, told by two 64-bit sums without
    carry of the rows' hashes."""
    rows = labelled.select("id", "n", F.explode("tokens").alias("token"))
    alike = rows.groupBy("token").agg(
        F.sum("n").alias("n"), F.bit_xor(F.xxhash64("id")).alias("rows"),
        F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("again"),
    ).where(F.col("n") >= least)
    items = alike.groupBy("n", "rows", "again").agg(F.collect_set("token").alias("all"))
    return items.select(F.array_min("all").alias("item"), F.explode("all").alias("token"))


def _baskets(labelled: DataFrame, index: DataFrame) -> DataFrame:
    """``items``: a row for each labelled row, dealt evenly."""
    weighed = (
        labelled.select("id", "n", "verdict", F.explode("tokens").alias("token"))
        .join(index, "token")
        .groupBy("id", "n", "verdict").agg(F.array_sort(F.collect_set("item")).alias("items"))
        .groupBy(F.concat("items", F.array(F.concat(F.lit(_LABEL), "verdict"))).alias("items"))
        .agg(F.sum("n").alias("n"))
    )
    pieces = weighed.select(
        "items", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {PIECE}"))).alias("piece"))
    rest = F.least(F.lit(PIECE).cast("long"), F.col("n") - F.col("piece") * PIECE)
    # by number and not by chance, so that a task that runs again makes the same rows
    return pieces.repartition("items", "piece").select(
        "items", F.explode(F.sequence(F.lit(1).cast("long"), rest)).alias("copy")).select("items")


def mined_rules(labelled: DataFrame, scratch: Scratch, least_support: float = LEAST_SUPPORT,
                least_confidence: float = LEAST_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """``rule, size, item, confidence`` with a row per item of each rule that says
    block, and ``item, token``, from ``labelled(id, n, tokens, verdict)``."""
    spark = labelled.sparkSession
    total = labelled.agg(F.sum("n")).first()[0]
    if not total or labelled.where(F.col("verdict") == BLOCK).isEmpty():
        return (spark.createDataFrame([], "rule long, size int, item string, confidence double"),
                spark.createDataFrame([], "item string, token string"))
    # at most tokens-per-URL / least_support tokens are frequent
    index = scratch.save(_item_tokens(labelled, least_support * total))
    baskets = scratch.save(_baskets(labelled, _small(index)))
    model = FPGrowth(itemsCol="items", minSupport=least_support, minConfidence=least_confidence).fit(baskets)
    says = model.associationRules.where(F.col("consequent") == F.array(F.lit(_LABEL + BLOCK)))
    says = scratch.save(says.select(F.array_sort("antecedent").alias("items"), "confidence"))
    # drop a rule if one of its subsets is a rule at least as certain
    shorter = says.select(F.col("items").alias("part"), F.col("confidence").alias("as_sure"))
    covered = says.withColumn("one", F.explode("items")).join(
        shorter.withColumn("one", F.get("part", F.lit(0))), "one"
    ).where(
        (F.size("part") < F.size("items")) & (F.col("as_sure") >= F.col("confidence"))
        & (F.size(F.array_except("part", "items")) == 0)
    ).select("items").distinct()
    kept = says.join(covered, "items", "left_anti").select(
        F.xxhash64("items").alias("rule"), F.size("items").alias("size"), F.explode("items").alias("item"),
        "confidence")
    return scratch.save(kept), index


def _small(table: DataFrame) -> DataFrame:
    """A table broadcast if its count allows."""
    return F.broadcast(table) if table.count() <= BROADCAST_RULES else table


def matches(urls: DataFrame, rules: DataFrame, index: DataFrame) -> DataFrame:
    """``id, confidence`` of the URLs of ``urls(id, tokens)`` that have all items of
    a rule, an item by any of its tokens; the confidence is that of the surest."""
    has = (
        urls.select("id", F.explode("tokens").alias("token")).join(_small(index), "token")
        .select("id", "item").distinct())
    hits = has.join(_small(rules), "item")
    return (
        hits.groupBy("id", "rule", "size", "confidence").agg(F.count("*").alias("n"))
        .where(F.col("n") == F.col("size"))
        .groupBy("id").agg(F.max("confidence").alias("confidence"))
    )


# ---- the operator ---------------------------------------------------------


def judged(pages: DataFrame, rules=RULES, least_support: float = LEAST_SUPPORT,
           least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """``page_id, host, path, rule, verdict, confidence`` per row of ``pages``;
    the confidence is that of the mined rule, where one decided."""
    scratch = Scratch(pages.sparkSession)
    parts = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    known = parts.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    # equal URLs are judged once
    urls = scratch.save(
        known.groupBy("url", "host", "path", "rule").agg(F.count("*").alias("n"))
        .withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
        .withColumn("id", F.xxhash64("url"))
    )
    labelled = urls.where("rule is not null").select(
        "id", "n", "tokens", rule_verdict(F.col("rule"), rules).alias("verdict"))
    mined, index = mined_rules(labelled, scratch, least_support, least_confidence)
    found = matches(urls.where("rule is null").select("id", "tokens"), mined, index)
    decided = urls.join(found, "id", "left").select("url", "confidence")
    joined = known.join(decided.withColumnRenamed("url", "u"), F.col("url").eqNullSafe(F.col("u")), "left")
    method = F.when(F.col("confidence").isNotNull(), BLOCK).otherwise(ALLOW)
    return joined.select(
        "page_id", "host", "path", "rule",
        F.coalesce(rule_verdict(F.col("rule"), rules), method).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence"))
