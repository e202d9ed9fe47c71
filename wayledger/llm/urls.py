"""URL filtering by association rules.

Every labelled url becomes a set of tokens and its verdict. Tokens that the same urls have are one
item, since no rule can tell them apart. FP-growth mines combinations of items that are frequent
together with a verdict; rules that are not confident enough, or that add nothing to a more general
rule, are pruned. A rule is filed under its rarest item, so a url meets only rules one of whose tokens
it has; the other items are then tested. Explicit rules come before mined ones.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

MIN_CONFIDENCE = 0.6
#: Labelled urls that must agree before a combination counts, however few or many there are in all.
MIN_COUNT = 20
ALLOW, BLOCK = "verdict=allow", "verdict=block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From behind the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From behind the host to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """What a url has: its scheme, every suffix of its host, words of its path, names of its query.

    Numbers become ``#``: a running number says nothing about the next url.
    """
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))),
                           lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.greatest(F.size(labels), F.lit(1))), ".")))
    words = F.filter(F.split(F.lower(path), r"[/._\-]+"), lambda x: x != "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "[&;]"), lambda x: F.split_part(x, F.lit("="), F.lit(1))), lambda x: x != "")
    return F.array_distinct(F.concat(
        F.array(F.concat(F.lit("s:"), F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))),
        F.when(F.size(labels) > 0, suffixes).otherwise(F.array().cast("array<string>")),
        F.transform(words, lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"[0-9]+", "#"))),
        F.transform(names, lambda x: F.concat(F.lit("q:"), x))))


def parts(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path) of every row."""
    url = F.col("url").cast("string")
    return pages.select("page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))


def explicit(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does.

    A rule (verdict, ``host/path``) fits its host and all subdomains where the url's path starts
    with the rule's. Of equally long rules the one named first wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1]), reverse=True)[::-1]:
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def items_of(rows: DataFrame, least: float) -> DataFrame:
    """(item, tokens, freq): tokens that the same urls of ``rows`` (url, tokens) have, named by the first of them.

    ``freq`` counts rows, repeats included; items in fewer than ``least`` are left out. Two digests and the
    number of a token's urls stand for the set of them.
    """
    by_url = rows.groupBy("url").agg(F.first("tokens").alias("tokens"), F.count("*").alias("copies"))
    by_token = by_url.select("url", "copies", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), F.sum("copies").alias("freq"), F.bit_xor(F.xxhash64("url")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit("again"), "url")).alias("y")).where(F.col("freq") >= least)
    # Tokens of one item stand in one url together, so a list is no longer than a url.
    return by_token.groupBy("n", "freq", "x", "y").agg(F.array_sort(F.collect_list("token")).alias("tokens")).select(
        F.col("tokens")[0].alias("item"), "tokens", "freq")


def mine(urls: DataFrame, min_support: float = 0.0, min_confidence: float = MIN_CONFIDENCE,
         min_count: int = MIN_COUNT) -> DataFrame:
    """Rules of labelled urls: (rule_id, verdict, tokens, key, needs, filed, confidence, lift, support).

    ``urls`` has (url, host, path, bad). A rule says a verdict for urls with one token at least of each
    list in ``needs``; ``tokens`` names each list by its first. Pruned are rules with less confidence than
    asked, rules no better than chance, and rules to which a more general rule of the same verdict has at
    least the same confidence. ``key`` is the item of the rule that the fewest urls have, ``filed`` its
    tokens. A combination counts from ``min_count`` labelled rows on, at any size of the table;
    ``min_support`` asks for a share of them besides. All labelled rows count, repeated ones each time;
    there may be none, then there are no rules.
    """
    rows = materialise(urls.select("url", "bad", tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens")))
    n = max(rows.count(), 1)
    least = max(min_count, min_support * n)
    items = materialise(items_of(rows, least))
    verdict = F.when(F.col("bad"), BLOCK).otherwise(ALLOW)
    # The first token of an item stands for it; one url has each once.
    own = (rows.select("url", F.explode("tokens").alias("item")).distinct().join(items.select("item"), "item")
           .groupBy("url").agg(F.collect_list("item").alias("items")))
    baskets = materialise(rows.select("url", verdict.alias("verdict")).join(own, "url").select(F.array_append("items", F.col("verdict")).alias("items")))
    # Urls without a frequent token bear no rule but count in the shares. Half a url less lets no rounding ask for one more.
    verdicts = {r["bad"]: r["count"] for r in rows.groupBy("bad").count().collect()}
    share = F.when(F.col("consequent")[0] == BLOCK, verdicts.get(True, 0) / n).otherwise(verdicts.get(False, 0) / n)
    held = baskets.count()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(0.0, (least - 0.5) / max(held, 1))), minConfidence=min_confidence).fit(baskets)
    rules = (model.associationRules.where(F.col("consequent")[0].isin(ALLOW, BLOCK)).withColumn("lift", F.col("confidence") / share)
             .where(F.col("lift") > 1 + 1e-12)
             .select(F.col("consequent")[0].alias("verdict"), F.array_sort("antecedent").alias("tokens"), "confidence", "lift",
                     (F.col("support") * held / n).alias("support")))
    rules = materialise(rules.withColumn("rule_id", F.concat_ws(" ", F.concat_ws(" ", "tokens"), "verdict")))
    keyed = (rules.select("rule_id", F.explode("tokens").alias("item")).join(items.withColumnRenamed("tokens", "list"), "item")
             .groupBy("rule_id").agg(F.min(F.struct("freq", "item", "list")).alias("rarest"), F.collect_list("list").alias("needs"))
             .select("rule_id", F.col("rarest.item").alias("key"), F.col("rarest.list").alias("filed"), "needs"))
    rules = rules.join(keyed, "rule_id")
    general = rules.select(F.col("key").alias("token"), F.col("verdict").alias("g_verdict"), F.col("tokens").alias("g_tokens"),
                           F.col("confidence").alias("g_confidence"))
    covered = (rules.select("rule_id", "verdict", "tokens", "confidence", F.explode("tokens").alias("token"))
               .join(general, "token")
               .where((F.col("verdict") == F.col("g_verdict")) & (F.size("g_tokens") < F.size("tokens"))
                      & (F.col("g_confidence") >= F.col("confidence")) & (F.size(F.array_except("g_tokens", "tokens")) == 0))
               .select("rule_id").distinct())
    return rules.join(covered, "rule_id", "left_anti")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined): for each distinct url that a rule matches, the best by lift, confidence, support and text."""
    distinct = urls.select("url", "host", "path").distinct()
    tokens = distinct.withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path")))
    filed = rules.select(F.explode("filed").alias("key"), F.struct("lift", "confidence", "support", "rule_id", "verdict").alias("rule"), "needs")
    hits = (tokens.select("url", "tokens", F.explode("tokens").alias("key")).join(filed, "key")
            .where(F.forall("needs", lambda some: F.arrays_overlap(some, F.col("tokens")))))
    return hits.groupBy("url").agg(F.max("rule").alias("mined"))


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]] = (), **options) -> DataFrame:
    """(page_id, url, host, path, rule, mined_rule, confidence, verdict) for every row of ``pages``.

    ``labelled`` has (page_id, bad); a page labelled twice counts twice, ids that are null label
    nothing. The verdict is the explicit rule's, else the best mined rule's, else allow. Null urls
    and urls without ``://`` have an empty host and path, and only explicit rules cannot fit them.
    Repeated rows come out as often as they go in; an empty table gives no rows.
    """
    urls = parts(pages)
    known = urls.where("url is not null").join(labelled.select("page_id", "bad").where("bad is not null"), "page_id").select("url", "host", "path", "bad")
    best = match(urls.where("url is not null"), mine(known, **options))
    rule, kind = explicit(F.col("host"), F.col("path"), rules)
    mined = F.when(F.col("mined.verdict") == BLOCK, "block").otherwise("allow")
    return urls.join(best, "url", "left").select(
        "page_id", "url", "host", "path", rule.alias("rule"), F.col("mined.rule_id").alias("mined_rule"),
        F.col("mined.confidence").alias("confidence"), F.coalesce(kind, mined).alias("verdict"))
