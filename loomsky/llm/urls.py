"""URL filtering by given rules and by association rules mined from labelled pages.

A URL is a set of tokens: the labels and endings of its host, its path segments, its parameters' names. FP-growth finds the
sets of tokens that go with the label ``block`` among labelled pages. Rules below the least support or confidence go, and
so do rules that a shorter one with as much confidence makes idle. What is left matches by an inverted index: a rule lies under its
rarest token, a URL looks up its tokens, and the rule's other tokens are checked on what meets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_up_to, stored

LABEL = "label=block"
#: tokens of a mined rule at most: longer ones say more of the pages that they were mined from than of others
MOST_TOKENS = 4


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` and for null."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens: ``host:`` each label, ``end:`` the last two and the last label, ``dir:`` each path segment but numbers,
    ``file:`` the file's ending, ``arg:`` each parameter's name, ``frag:`` where there is a fragment."""
    labels = F.filter(F.split(host_of(url), r"\."), lambda x: x != "")
    segments = F.filter(F.split(path_of(url), "/"), lambda x: (x != "") & ~x.rlike(r"^[0-9]+(\.[a-z]+)?$"))
    query = F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(""))
    names = F.filter(F.transform(F.split(query, "&"), lambda a: F.regexp_extract(a, "^([^=]*)", 1)), lambda a: a != "")
    ending = F.regexp_extract(path_of(url), r"\.([A-Za-z0-9]{1,8})$", 1)

    def named(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.concat(F.lit(f"{kind}:"), v))

    return F.array_distinct(
        F.concat(
            named("host", labels),
            named("end", F.filter(F.array(F.substring_index(host_of(url), ".", -1), F.substring_index(host_of(url), ".", -2)), lambda x: x != "")),
            named("dir", segments),
            named("file", F.filter(F.array(ending), lambda x: x != "")),
            named("arg", names),
            F.when(F.coalesce(url, F.lit("")).contains("#"), F.array(F.lit("frag:"))).otherwise(F.array().cast("array<string>")),
        )
    )


def given_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The rule that fits, as (rule, verdict); null if none does. ``rules`` are (``host/path``, ``allow`` or ``block``), a list that
    a user writes; a rule fits its host and all subdomains where the path starts with the rule's. The longest wins, of equals the last."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def mine(urls: DataFrame, *, min_support: float, min_count: int, min_confidence: float, max_tokens: int = MOST_TOKENS) -> DataFrame:
    """Blocking rules ``tokens, confidence, support`` from ``urls`` (tokens, blocked), pruned. A small table: each rule needs
    ``min_support`` of all labelled pages, and ``min_count`` of them, and up to ``max_tokens`` tokens. No labelled pages give no rules.

    Tokens that lie in the same pages are mined as one, the least of them, and its rules hold for each: sets of several of them
    would be as many as the subsets of a long URL, and idle all of them."""
    spark = urls.sparkSession
    empty = spark.createDataFrame([], "tokens array<string>, confidence double, support double")
    n = urls.count()
    if not n:
        return empty
    least = min(1.0, max(min_support, min_count / n))
    pages = F.sum(F.xxhash64("tokens").cast("decimal(38,0)")).alias("pages")
    often = urls.select("tokens", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), pages).where(F.col("n") >= least * n - 1e-6)
    alike = often.groupBy("n", "pages").agg(F.min("token").alias("first"), F.collect_list("token").alias("all"))
    classes = {r.first: r.all for r in alike.select("first", "all").collect()}  # each has the least support
    known = F.array_intersect("tokens", F.array(*map(F.lit, classes))) if classes else F.array().cast("array<string>")
    baskets = urls.select(F.when(F.col("blocked"), F.array_append(known, F.lit(LABEL))).otherwise(known).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.expr(f"consequent = array('{LABEL}') and size(antecedent) <= {max_tokens}"))
    several = spark.createDataFrame([(k, v) for k, v in classes.items() if len(v) > 1], "first string, all array<string>")
    for_each = F.map_from_entries(F.collect_list(F.struct("first", "all")))
    rules = rules.crossJoin(F.broadcast(several.agg(for_each.alias("all"))))
    named = F.aggregate(
        "antecedent", F.array(F.array().cast("array<string>")),
        lambda sets, t: F.flatten(F.transform(sets, lambda s: F.transform(F.coalesce(F.try_element_at("all", t), F.array(t)), lambda m: F.array_append(s, m)))),
    )
    rules = rules.select(F.explode(named).alias("tokens"), "confidence", "support").withColumn("tokens", F.sort_array("tokens"))
    shorter = rules.select(F.col("tokens").alias("t2"), F.col("confidence").alias("c2"), F.explode("tokens").alias("first"))
    longer = rules.select("tokens", "confidence", F.explode("tokens").alias("first"))
    idle = longer.join(shorter, "first").where(
        (F.size("t2") < F.size("tokens")) & (F.col("c2") >= F.col("confidence")) & (F.size(F.array_except("t2", "tokens")) == 0)
    )
    return rules.join(idle.select("tokens").distinct(), "tokens", "left_anti")


def filter_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]],
    *,
    min_support: float = 0.002,
    min_count: int = 8,
    min_confidence: float = 0.6,
    max_tokens: int = MOST_TOKENS,
) -> DataFrame:
    """Judge the ``url`` of each page: ``page_id, host, path, rule, verdict, confidence``, one row for each row of ``pages``.

    A given rule decides where one fits. Elsewhere a page is blocked if a mined rule matches, whose ``confidence`` is returned (the
    greatest of those that match), and allowed otherwise. Pages whose page_id has ``labels.quality`` 0 are what mining takes for blocked.

    A null URL, or one without ``://``, has an empty host and path, fits no rule and has few tokens or none. Rows that share
    a page_id are judged each for itself; rows without one are judged and don't count for mining. Contradicting labels
    count as blocked. Other columns are ignored.
    """
    url = F.col("url")
    pages = pages.select(F.col("page_id").cast("long"), "url")
    known = labels.where("quality is not null").groupBy(F.col("doc_id").alias("page_id")).agg((F.min("quality") == 0).alias("blocked"))
    labelled = pages.join(known, "page_id").select(url_tokens(url).alias("tokens"), "blocked")
    mined = stored(mine(labelled, min_support=min_support, min_count=min_count, min_confidence=min_confidence, max_tokens=max_tokens))

    # URLs with the same tokens are matched once.
    tokens = pages.select(url_tokens(url).alias("tokens")).distinct()
    each = tokens.select("tokens", F.explode("tokens").alias("token"))
    rarity = each.join(mined.select(F.explode("tokens").alias("token")).distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    of_rules = mined.select(F.col("tokens").alias("needs"), "confidence", F.explode("tokens").alias("token"))
    index = of_rules.join(rarity, "token", "left").groupBy("needs", "confidence").agg(
        F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token")
    )
    matched = (
        each.join(index, "token").where(F.size(F.array_except("needs", "tokens")) == 0)
        .groupBy("tokens").agg(F.max("confidence").alias("confidence"))
    )
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), url_tokens(url).alias("tokens"))
    judged = judged.withColumn("given", given_rule(F.col("host"), F.col("path"), rules)).join(broadcast_up_to(stored(matched)), "tokens", "left")
    return judged.select(
        "page_id", "host", "path", F.col("given.rule").alias("rule"),
        F.coalesce("given.verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence",
    )
