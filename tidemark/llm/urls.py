"""URL filters by association rules, in DataFrame functions only.

A URL becomes a set of tokens: its host's domain suffixes, its path's segments with digits folded,
and the first digit of those that begin with one. FP-growth mines labelled token sets, each with
its verdict as one more item; rules that imply a verdict are pruned by support, by confidence in
the fitted and in a held-out part of the labels, by lift, by confidence in hosts that they were not
learned from, by the unlabelled URLs they reach, and where a shorter rule is as sure. Labels that lie
in one corner of a domain so say nothing of the rest of it. What remains is an inverted index from
token to rule; a URL matches a rule when all the rule's tokens are met, and its surest rule decides.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rules where a caller gives none: verdict, host, start of the path. The query gives its own.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("allow", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

#: A URL with more than one in HOT_SHARE of all rows is joined by broadcast.
HOT_SHARE = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_verdict(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, null where none does."""
    chain: Column | None = None
    for verdict, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        found = F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))
        chain = F.when(fits, found) if chain is None else chain.when(fits, found)
    return chain if chain is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: h: and each suffix of the host at a dot, p<k>: and each segment of the path, p<k>^ and its first digit."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(labels, lambda _, i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i + 1, F.size(labels) - i), ".")))
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    segments = F.transform(parts, lambda s, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), F.regexp_replace(s, "[0-9]+", "0")))
    firsts = F.transform(parts, lambda s, i: F.when(s.rlike("^[0-9]"), F.concat(F.lit("p"), i.cast("string"), F.lit("^"), F.substring(s, 1, 1))))
    return F.array_distinct(F.concat(F.when(host == "", F.array().cast("array<string>")).otherwise(suffixes), segments, F.filter(firsts, lambda s: s.isNotNull())))


def _baskets(labelled: DataFrame, others: DataFrame, support: float) -> DataFrame:
    """url and its tokens of enough support; of tokens that the same URLs hold, one stands for all.

    So a path or host that many URLs share is one item, not a chain with all its subsets. The token
    that stands is that of the fewest rows n of others(tokens, n), then the least: it says least
    about URLs without a label.
    """
    each = labelled.select("url", F.explode("tokens").alias("token"))
    own = F.xxhash64("url").cast("decimal(38,0)")
    least = labelled.count() * support
    sizes = written(each.groupBy("token").agg(F.count("*").alias("n"), F.sum(own).alias("extent")).where(F.col("n") >= least))
    beyond = others.select("n", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("n").alias("beyond"))
    narrow = F.min(F.struct(F.coalesce("beyond", F.lit(0)).alias("beyond"), "token"))["token"]
    kept = sizes.join(beyond, "token", "left").groupBy("n", "extent").agg(narrow.alias("token")).select("token")
    return each.join(kept, "token").groupBy("url").agg(F.collect_set("token").alias("items"))  # a URL's own tokens


def mine_rules(labelled: DataFrame, unlabelled: DataFrame, *, support: float = 0.005, confidence: float = 0.9, lift: float = 1.02, reach: float = 0.5) -> DataFrame:
    """rule_id, tokens, verdict, confidence, support from labelled(url, host, tokens, blocked) and unlabelled(tokens), a row for each URL.

    A quarter of the URLs, by hash, is held out: a rule stays if it is as sure there, and meets a
    URL there. It must be as sure, too, in the hosts from whose labels it could not be known (see
    `_sure_elsewhere`), and of all URLs that it meets at least the share `reach` must be labelled.
    All rows are used. Labels of one kind only give no rules, as no token then tells them apart.
    """
    held = F.pmod(F.xxhash64("url", F.lit(7)), F.lit(4)) == 0
    labelled = written(labelled.withColumn("held", held))
    verdict = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    fits = labelled.where("not held").select("url", "tokens", verdict.alias("verdict"))
    # URLs with the same tokens are counted together
    others = written(unlabelled.groupBy("tokens").agg(F.count("*").alias("n")))
    items = _baskets(fits, others, support).join(fits.select("url", "verdict"), "url").select(F.array_append("items", F.concat(F.lit("="), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(written(items))
    implied = F.element_at("consequent", 1)
    told = model.associationRules.where(F.startswith(implied, F.lit("=")) & (F.col("lift") >= lift) & ~F.exists("antecedent", lambda t: F.startswith(t, F.lit("="))))
    rules = told.select(F.array_sort("antecedent").alias("tokens"), F.substring(implied, 2, 9).alias("verdict"), "confidence", "support")
    rules = written(rules.withColumn("rule_id", F.xxhash64("tokens", "verdict")))

    blocks = F.count_if("blocked").alias("blocks")
    sets = written(labelled.groupBy("host", "tokens", "held").agg(F.count("*").alias("n"), blocks))
    right = F.when(F.col("verdict") == "block", F.col("blocks")).otherwise(F.col("n") - F.col("blocks"))
    met = written(met_rules(sets, rules, "host", "held", "n", "blocks").groupBy("rule_id", "host", "held").agg(F.sum("n").alias("n"), F.sum(right).alias("right")))
    tried = met.where("held").groupBy("rule_id").agg(F.sum("n").alias("n"), F.sum("right").alias("right")).where(F.col("right") >= confidence * F.col("n"))
    rules = rules.join(tried.select("rule_id"), "rule_id").join(_sure_elsewhere(met, confidence, support * labelled.count()), "rule_id", "left_semi")
    rules = written(rules)
    every = sets.select("tokens", "n", F.col("n").alias("known")).unionByName(others.withColumn("known", F.lit(0).cast("long")))
    met = met_rules(every, rules, "n", "known").groupBy("rule_id").agg(F.sum("n").alias("n"), F.sum("known").alias("known"))
    rules = written(rules.join(met.where(F.col("known") >= reach * F.col("n")).select("rule_id"), "rule_id"))
    # a rule goes where a part of it is at least as sure: parts are found by the tokens they share
    part = rules.select(F.col("rule_id").alias("part"), F.col("verdict"), F.col("confidence").alias("sure"), F.size("tokens").alias("needs"), F.explode("tokens").alias("token"))
    whole = rules.select("rule_id", "verdict", "confidence", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    shared = whole.join(part, ["token", "verdict"]).where("size > needs and sure >= confidence").groupBy("rule_id", "part", "needs").count()
    return rules.join(shared.where("count = needs").select("rule_id").distinct(), "rule_id", "left_anti")


def _sure_elsewhere(met: DataFrame, confidence: float, least: float) -> DataFrame:
    """rule_id of the rules that are right in hosts they were not learned from, from met(rule_id, host, n, right).

    Each host is left out in turn: where the others' labels still give the rule, with their support
    and confidence, its labels try it. A rule that no host can be left out of names what one host
    holds and has nowhere else to be tried; it stays.
    """
    hosts = met.groupBy("rule_id", "host").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    whole = hosts.groupBy("rule_id").agg(F.sum("n").alias("of"), F.sum("right").alias("good"))
    rest, good = F.col("of") - F.col("n"), F.col("good") - F.col("right")
    known = (good >= least) & (good >= confidence * rest) & (rest > 0)
    tried = hosts.join(whole, "rule_id").groupBy("rule_id").agg(F.sum(F.when(known, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(known, F.col("right")).otherwise(0)).alias("right"))
    return tried.where(F.col("right") >= confidence * F.col("n")).select("rule_id")


def met_rules(token_sets: DataFrame, rules: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep`, rule_id, verdict, confidence for each rule all of whose tokens a row of token_sets(tokens, keep) holds.

    A rule is indexed by its rarest token among these rows, so a token that many of them and many
    rules share brings no rule by itself.
    """
    each = token_sets.select(*keep, "tokens", F.explode("tokens").alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("seen"))
    known = rules.select("rule_id", F.explode("tokens").alias("token")).join(counts, "token")
    rarest = known.groupBy("rule_id").agg(F.min(F.struct("seen", "token"))["token"].alias("token"))
    index = rules.join(rarest, "rule_id").select("rule_id", "verdict", "confidence", F.col("tokens").alias("needed"), "token")
    met = each.join(index, "token").where(F.size(F.array_intersect("tokens", "needed")) == F.size("needed"))
    return met.select(*keep, "rule_id", "verdict", "confidence")


def matched(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """url, mined, confidence: the verdict of its surest matching rule, allow before block where they are equally sure."""
    best = F.max(F.struct("confidence", (F.col("verdict") == "allow").alias("allows"), "verdict")).alias("best")
    return met_rules(token_sets, rules, "url").groupBy("url").agg(best).select("url", F.col("best.verdict").alias("mined"), F.col("best.confidence").alias("confidence"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labels: DataFrame | None = None, **options: float) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_confidence for each row of pages(page_id, url).

    A fixed rule decides where one fits; elsewhere the surest mined rule that matches, and what
    none matches is allowed. `labels` has (url, blocked); without it, the URLs that a fixed rule
    decides are the labelled ones, with its verdict. All others are unlabelled: no evidence for
    either verdict, but against a rule that meets more of them than `reach` allows. Null URLs and
    those without :// have an empty host and path, no rule, and are allowed. Repeated rows get a row
    each, and a URL of many rows is not gathered in one task; extra columns are ignored.
    """
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("fixed", fixed_verdict(F.col("host"), F.col("path"), rules))
    urls = rows.where("url is not null").groupBy("url").agg(F.count("*").alias("rows"))
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    urls = written(urls.withColumns({"fixed": fixed_verdict(F.col("host"), F.col("path"), rules), "tokens": url_tokens(F.col("host"), F.col("path"))}))
    if labels is None:
        known = urls.where("fixed is not null").select("url", "host", "tokens", (F.col("fixed.verdict") == "block").alias("blocked"))
        others = urls.where("fixed is null")
    else:
        # a URL with unlike labels counts as blocked
        told = written(labels.groupBy("url").agg(F.max("blocked").alias("blocked")).where("blocked is not null"))
        known = urls.join(told, "url").select("url", "host", "tokens", "blocked")
        others = urls.join(told, "url", "left_anti")
    mined = written(mine_rules(known, others.select("tokens"), **options))
    found = matched(urls.where("fixed is null").select("url", "tokens"), mined)
    found = written(found.join(urls.select("url", "rows"), "url"))
    # URLs with more than one in HOT_SHARE of all rows: fewer than HOT_SHARE by their very condition
    hot = F.col("rows") * HOT_SHARE > urls.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    few = found.where(hot).select("url", "mined", "confidence")
    open_rows = rows.where("url is not null and fixed is null")
    judged = open_rows.join(F.broadcast(few.select("url")), "url", "left_anti").join(found.where(~hot).select("url", "mined", "confidence"), "url", "left")
    judged = judged.unionByName(open_rows.join(F.broadcast(few), "url"))
    settled = rows.where("url is null or fixed is not null").withColumns({"mined": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    out = judged.unionByName(settled)
    verdict = F.coalesce("fixed.verdict", "mined", F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), F.col("confidence").alias("mined_confidence"))
