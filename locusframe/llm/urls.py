"""URL filters by association rules.

Labelled URLs become sets of tokens; Spark's FP-growth mines the token sets that
come with a label often enough, and those of enough confidence are rules.  The
rules are held by token, and a URL meets only the rules that its tokens name.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ident, stored

ALLOW, BLOCK = "allow", "block"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """Text after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _CAPITALS, _SMALL)


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule of (host, path, verdict) that fits, as a struct of rule and verdict; null if none does.

    A rule fits its host and all subdomains if the path starts with its own.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, each domain that the host is in, words of path and query.

    Numbers are one token, so that page counters do not count as words.
    """
    h, rest = host(url), F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1), F.lit("")))
    labels = F.split(h, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("host:"), F.array_join(F.slice(labels, -k, k), ".")))
    words = F.filter(F.split(rest, r"[^\p{L}\p{N}_%-]+"), lambda w: w != "")
    words = F.transform(words, lambda w: F.concat(F.lit("word:"), F.when(w.rlike(r"^\d+$"), F.lit("0")).otherwise(w)))
    scheme = F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))
    return F.array_distinct(F.concat(F.array(scheme), F.when(h == "", F.array().cast("array<string>")).otherwise(domains), words))


def mine(labelled: DataFrame, support: float = 0.005, confidence: float = 0.9) -> DataFrame:
    """Rules from rows of ``tokens`` and ``label``.

    A rule is a set of tokens, however many, that comes with one label in at least
    ``support`` of the rows, and with that label in at least ``confidence`` of the rows
    that have the tokens.  Of tokens that come in exactly the same rows only the first by
    name is mined; ``members`` has, for each of ``items``, all those tokens.  A rule is dropped where a proper subset of it gives the same
    label with no less confidence.  Returns ``rule``, ``items``, ``label``, ``confidence``
    and ``support``.
    """
    known = stored(labelled.filter("label is not null").withColumn("row", F.monotonically_increasing_id()), "labelled")
    # tokens of exactly the same rows would double the token sets; the first by name stands for them all
    rows = known.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.sum(F.xxhash64("row") % 1_000_003).alias("s")
    )
    rows = rows.filter(F.col("n") >= support * known.count())
    alike = stored(rows.groupBy("n", "x", "s").agg(F.min("token").alias("token"), F.array_sort(F.collect_list("token")).alias("members")).select("token", "members"), "tokens")
    held = known.select("row", F.explode("tokens").alias("token")).join(alike, "token", "left_semi")
    held = held.groupBy("row").agg(F.collect_list("token").alias("tokens"))
    marked = F.concat(F.lit("label:"), F.col("label"))
    held = known.select("row", "label").join(held, "row", "left")
    baskets = held.select(F.array_append(F.coalesce("tokens", F.array().cast("array<string>")), marked).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    total = baskets.count()
    found = stored(model.freqItemsets, "itemsets")
    is_label = lambda x: x.startswith("label:")
    split = found.select(
        F.array_sort(F.filter("items", lambda x: ~is_label(x))).alias("items"), F.filter("items", is_label).alias("label"), "freq"
    ).filter(F.size("items") > 0)
    alone = split.filter(F.size("label") == 0).select("items", F.col("freq").alias("all"))
    both = split.filter(F.size("label") == 1).join(alone, "items").select(
        "items", F.expr("substring(label[0], 7)").alias("label"), (F.col("freq") / F.col("all")).alias("confidence"), (F.col("freq") / F.lit(max(total, 1))).alias("support")
    )
    both = stored(both, "weighed")
    # by size: the greatest confidence of a set's proper subsets is that of the sets one item smaller and of theirs
    kept = both.limit(0)
    below = both.limit(0).select(F.col("items").alias("sub"), "label", F.col("confidence").alias("c"))
    for size in range(1, (both.agg(F.max(F.size("items"))).first()[0] or 0) + 1):
        level = both.filter(F.size("items") == size)
        smaller = level.select("items", "label", F.explode(_one_smaller(F.col("items"))).alias("sub")).join(below, ["sub", "label"])
        smaller = smaller.groupBy("items", "label").agg(F.max("c").alias("c"))
        level = stored(level.join(smaller, ["items", "label"], "left").select(*both.columns, F.coalesce("c", F.lit(0.0)).alias("c")), "level")
        kept = kept.union(level.filter((F.col("confidence") >= confidence) & (F.col("confidence") > F.col("c"))).drop("c"))
        below = level.select(F.col("items").alias("sub"), "label", F.greatest("confidence", "c").alias("c"))
    kept = stored(kept.withColumn("rule", _text("items")), "rules")
    named = kept.select("rule", F.posexplode("items").alias("k", "token")).join(alike, "token").groupBy("rule").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "members"))), lambda x: x["members"]).alias("members")
    )
    return stored(kept.join(named, "rule"), "kept-rules")


def _text(items: str) -> Column:
    """A rule as text, with the label of its row."""
    return F.concat_ws(" ", F.array_join(items, " & "), F.lit("=>"), F.col("label"))


def _one_smaller(items: Column) -> Column:
    """The subsets that lack one item."""
    return F.transform(items, lambda x: F.filter(items, lambda y: y != x))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """For each row of ``key`` and ``tokens`` that a rule fits: its best rule.

    The inverted index has a row per rule, item and token that stands for the item; a rule
    fits where a token of each of its items is met, and is then named by the first of
    them.  The most confident rule wins, then the one with more support, then the longer,
    then the first by text.  Returns ``key``, ``label``, ``rule`` and ``confidence``.
    """
    index = rules.select(F.posexplode("members").alias("item", "tokens"), "rule", "label", "confidence", "support", F.size("items").alias("size"))
    index = index.withColumn("token", F.explode("tokens")).drop("tokens")
    met = urls.select("key", F.explode("tokens").alias("token")).join(index, "token")
    facts = [F.first(c).alias(c) for c in ("label", "confidence", "support", "size")]
    met = met.groupBy("key", "rule", "item").agg(F.min("token").alias("token"), *facts)
    fits = met.groupBy("key", "rule").agg(F.array_sort(F.collect_list("token")).alias("tokens"), *facts).filter("size(tokens) = size")
    fits = fits.withColumn("rule", _text("tokens"))
    best = F.min(F.struct(-F.col("confidence"), -F.col("support"), -F.col("size"), F.col("rule"), F.col("label"), F.col("confidence"))).alias("b")
    return fits.groupBy("key").agg(best).select("key", F.col("b.label").alias("label"), F.col("b.rule").alias("rule"), F.col("b.confidence").alias("confidence"))


def judge(
    pages: DataFrame, rules: list[tuple[str, str, str]], labels: DataFrame | None = None, id_col: str = "page_id",
    url_col: str = "url", support: float = 0.005, confidence: float = 0.9,
) -> DataFrame:
    """Verdict on every URL: that of the longest listed rule, else that of the best mined one, else allow.

    ``labels`` has ``url`` and ``label`` (allow or block); without it, the URLs that a
    listed rule judges are the labels.  Mined rules see distinct token sets of URLs, so
    equal ones are matched once.  Returns a row per input row: ``id``, ``host``, ``path``,
    ``rule`` (listed), ``verdict``, ``mined_rule`` and ``confidence``.  A null URL, or one
    without `://`, has an empty host and path; no rule fits it.  A null id counts as the
    smallest bigint, and other columns are not read.
    """
    urls = pages.select(ident(id_col).alias("id"), F.col(f"`{url_col}`").alias("url"))
    rows = urls.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rows = rows.withColumn("listed", listed(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens(F.coalesce("url", F.lit(""))))
    rows = stored(rows.withColumn("key", F.xxhash64("tokens")).drop("url"), "urls")
    if labels is None:
        labelled = rows.select("tokens", F.col("listed.verdict").alias("label"))
    else:
        labelled = labels.select(tokens(F.coalesce("url", F.lit(""))).alias("tokens"), "label")
    mined = mine(labelled, support, confidence)
    open_ = rows.filter("listed is null").groupBy("key").agg(F.first("tokens").alias("tokens"))
    found = stored(match(open_, mined), "matched")
    out = rows.join(found, "key", "left")
    mined_col = lambda c: F.when(F.col("listed").isNull(), F.col(c))
    return out.select(
        "id", "host", "path", F.col("listed.rule").alias("rule"),
        F.coalesce("listed.verdict", found["label"], F.lit(ALLOW)).alias("verdict"),
        mined_col("rule").alias("mined_rule"), mined_col("confidence").alias("confidence"),
    )
