"""URL filters: a block and allow list, and association rules of URL tokens mined by FP-growth. Spark functions only."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.checkpoint import stored
from graphloom.plans.sizes import small_side

#: Fixed values of the contract: (verdict, host and path).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Host words that label a url as unwanted where nobody has labelled it.
SEEDS = ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "warez")
BLOCK = "label=block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, after the first ``://``, and the path after it; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; nulls where none does. For lists of some hundred rules."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, below = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(slash + below))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct sorted tokens: the host's words, its last label, the path's segments and the query's keys; digits are one token."""
    named = lambda words, kind: F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(kind), w))
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0")
    labels = F.regexp_replace(plain(host), r"\.[^.]*$", "")
    last = F.regexp_extract(plain(host), r"([^.]*)$", 1)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda p: plain(F.substring_index(p, "=", 1)))
    return F.array_sort(F.array_distinct(F.concat(named(F.split(labels, "[.-]"), "host="), named(F.array(last), "top="), named(F.split(plain(path), "[/.]"), "path="), named(keys, "query="))))


def mine(tagged: DataFrame, min_support: float = 0.0005, min_count: int = 10, min_confidence: float = 0.8, min_lift: float = 1.5, most_tokens: int = 3) -> DataFrame:
    """(tokens, confidence, support, key) from (tokens, blocked): rules "these tokens, so block".

    FP-growth counts the token combinations with the label among their items. A rule is pruned below the
    confidence, the support (a share of the urls, and a count) or the lift, or above so many tokens. ``key`` is its rarest token, under which
    the inverted index keeps it.
    """
    baskets = tagged.select(F.when(F.col("blocked"), F.array_append("tokens", F.lit(BLOCK))).otherwise(F.col("tokens")).alias("items")).where(F.size("items") > 0)
    schema = "tokens array<string>, confidence double, support double, key string"
    seen = tagged.agg(F.count_if(F.size("tokens") > 0).alias("n"), F.count_if("blocked").alias("blocked")).first()
    if seen.blocked < max(1, min_count):
        return tagged.sparkSession.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_count / seen.n)), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where((F.col("consequent") == F.array(F.lit(BLOCK))) & (F.size("antecedent") <= most_tokens) & (F.col("lift") >= min_lift))
    counts = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("key"), F.col("freq"))
    each = rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support").withColumn("key", F.explode("tokens")).join(counts, "key")
    return each.groupBy("tokens").agg(F.max("confidence").alias("confidence"), F.max("support").alias("support"), F.min_by("key", F.struct("freq", "key")).alias("key"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, seeds: tuple[str, ...] = SEEDS, labels: DataFrame | None = None, id_column: str = "page_id", url_column: str = "url", **settings) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the tokens of the association rule that blocks, if any) of every row.

    The labels to learn from are the list's verdicts and, where it has none, "block" for urls with a seed
    word in the host; all others count against a rule. Rows of ``labels`` (page_id, blocked) go before the
    seed words; of several for an id, one that blocks wins. A url that the list leaves open is blocked if a
    mined rule's tokens are all among its own, else allowed. A null url, and one without ``://``, has an
    empty host and path, no tokens, and is allowed. Repeated rows come back as often; no rows give none.
    """
    host, path = host_and_path(F.col(url_column))
    parts = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    tokens = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(url_tokens(F.col("url"), F.col("host"), F.col("path")))
    known = stored(parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("listed"), tokens.alias("tokens")), "urls")
    seeded = F.arrays_overlap("tokens", F.array(*[F.lit(f"host={s}") for s in seeds]))
    tagged = known.withColumn("said", F.lit(None).cast("boolean"))
    if labels is not None:
        tagged = known.join(labels.where(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("blocked").alias("said")), "page_id", "left")
    mined = stored(mine(tagged.select("tokens", F.coalesce(F.col("listed") == "block", "said", seeded).alias("blocked")), **settings), "url-rules")
    index = small_side(mined.withColumnRenamed("tokens", "needs"))
    # Urls with the same tokens are matched once, against the rules kept under one of these.
    kinds = known.where(F.col("listed").isNull()).select("tokens").distinct()
    met = kinds.select("tokens", F.explode("tokens").alias("key")).join(index, "key").where(F.size(F.array_except("needs", "tokens")) == 0)
    best = met.groupBy("tokens").agg(F.max_by("needs", F.struct("confidence", "support", "needs")).alias("mined"), F.max("confidence").alias("confidence"))
    out = known.join(best, "tokens", "left")
    open_ = F.col("listed").isNull()
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), F.when(open_, F.array_join("mined", " ")).alias("mined"), F.when(open_, F.col("confidence")).alias("confidence"))
