"""URL filters: stated rules first, and for all other URLs association rules that FP-growth mines from those which the rules judge.

A URL is a set of tokens: scheme, labels of the host, segments of the path (numbers are one token), ending, keys of the query.
Spark's FP-growth counts token combinations over the distinct labelled URLs. Combinations with a label that reach the
support and the confidence become rules; a rule that adds tokens to another one without more confidence is pruned. Rules
are posted under their rarest token; a URL meets only the rules under tokens of its own, which it then must hold in full.

Tokens that occur in exactly the same labelled URLs count as one item, told by their number and 128 bits of those URLs' hashes: else
a family of URLs with n keys in common would have 2**n combinations. A token is frequent in min_support of the labelled
URLs, so there are at most (mean number of tokens) / min_support of them, which bounds all that is broadcast.

Nulls: a null URL, or one without `://`, has an empty host and path, no tokens, and the verdict `otherwise`; so has a URL that
no mined rule fits, and every undecided URL where nothing is labelled. Ties: of stated rules that fit, the longest one wins, of equally long ones
the last in order of text; of mined ones that of the largest confidence, then support, then the fewest tokens, then the last text. Repeated rows are judged
each, and count once in mining. Very long URLs are taken whole. An empty table has no rows. Columns of the table other than id and URL take no part.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, if_few, lasting, look_up, release

#: Share of the distinct labelled URLs that a combination needs, and share of its URLs that have its label.
MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.8
RULES = "need array<string>, label string, confidence double, support double"

Stated = tuple[str, str, str]  # verdict, host, path


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def stated(host: Column, path: Column, rules: Sequence[Stated]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest stated rule that fits, or nulls. A rule's text is its host and path."""
    rule = verdict = None
    for said, of, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        rule = F.when(fits, of + start) if rule is None else rule.when(fits, of + start)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return (F.lit(None).cast("string"),) * 2 if rule is None else (rule, verdict)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL; none without `://`."""
    named = lambda kind, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(f"{kind}:"), x))
    low = ascii_lower(path)
    segments = F.transform(F.filter(F.split(low, "/"), lambda x: x != ""), lambda x: F.regexp_replace(x, r"^[0-9]+(?=\.|$)", "#"))
    ending = F.regexp_extract(low, r"\.([a-z0-9]+)$", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"^[^=]*", 0))
    scheme = ascii_lower(F.substring(url, F.lit(1), F.instr(url, "://") - 1))
    found = F.concat(
        named("scheme", F.array(scheme)), named("host", F.split(host, r"\.")), named("first", F.slice(segments, 1, 1)), named("path", segments),
        named("ending", F.array(ending)), named("query", keys), named("fragment", F.array(F.when(F.instr(url, "#") > 0, "#").otherwise(""))),
    )
    return F.when(F.instr(url, "://") > 0, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (need, label, confidence, support) of labelled URLs (url, tokens, label), pruned and written."""
    from pyspark.ml.fpm import FPGrowth

    single = lasting(labelled.select("url", "tokens", "label").dropDuplicates(["url", "label"]).withColumn("u", F.monotonically_increasing_id()).drop("url"))
    n = single.count()
    if not n:
        return single.sparkSession.createDataFrame([], RULES)
    label = F.concat(F.lit("="), "label")
    each = single.select("u", F.explode(F.array_append("tokens", label)).alias("token"))
    mark = lambda k: F.bit_xor(F.xxhash64("u", F.lit(k))).alias(f"mark{k}")
    counted = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), mark(0), mark(1))
    is_label = F.col("token").startswith("=")
    frequent = counted.where((F.col("n") >= min_support * n) | is_label)
    alike = frequent.groupBy("n", "mark0", "mark1", F.when(is_label, F.col("token")).alias("own")).agg(F.array_sort(F.collect_list("token")).alias("members"))
    items = lasting(alike.select(F.col("members")[0].alias("item"), "members", "n"))
    of = if_few(lasting(items.select("item", F.explode("members").alias("token"))), weight=F.octet_length("item") + F.octet_length("token"))
    baskets = lasting(each.join(of, "token").groupBy("u").agg(F.collect_set("item").alias("items")))
    found = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets).associationRules
    found = found.where(F.col("consequent")[0].startswith("=")).withColumn("r", F.monotonically_increasing_id())
    found = lasting(found.select("r", "antecedent", F.substring(F.col("consequent")[0], 2, 1 << 30).alias("label"), "confidence", "support"))
    whole = found.select("r", F.explode("antecedent").alias("item")).join(items, "item").groupBy("r").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("need"))
    rules = lasting(found.join(whole, "r").select("r", "need", "label", "confidence", "support"))
    general = holding(rules.select(F.col("r").alias("row"), F.col("need").alias("tokens")), rules)
    same = general.join(rules.select(F.col("r").alias("row"), F.col("label").alias("own"), F.size("need").alias("size"), F.col("confidence").alias("least")), "row")
    vain = same.where((F.col("rule.label") == F.col("own")) & (F.size("rule.need") < F.col("size")) & (F.col("rule.confidence") >= F.col("least"))).select(F.col("row").alias("r")).distinct()
    kept = lasting(rules.join(vain, "r", "left_anti").select("need", "label", "confidence", "support"))
    release(single, items, baskets, found, rules)
    return kept


def holding(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, rule) for each of the rules (written already) of which a row (row, tokens) holds all tokens.

    Rules are posted under the token that the fewest rules need.
    """
    needed = rules.select(F.explode("need").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()  # at most the frequent tokens
    rank = {r.token: k for k, r in enumerate(sorted(needed, key=lambda r: (r.n, r.token)))}
    order = F.from_json(F.lit(json.dumps(rank)), "map<string,int>")
    rule = F.struct("need", "label", "confidence", "support").alias("rule")
    rarest = F.array_min(F.transform("need", lambda t: F.struct(order[t].alias("k"), t.alias("token"))))["token"]
    index = lasting(rules.select(rarest.alias("key"), rule).groupBy("key").agg(F.collect_list("rule").alias("posted")))
    known = F.from_json(F.lit(json.dumps(list(rank))), "array<string>")
    held = rows.select("row", F.array_intersect("tokens", known).alias("held")).where("size(held) > 0")
    met = look_up(held.select("row", "held", F.explode("held").alias("key")), index, "key", weight=F.length(F.to_json("posted")))
    met = met.where("posted IS NOT NULL").select("row", "held", F.explode("posted").alias("rule"))
    return met.where(F.size(F.array_except("rule.need", "held")) == 0).select("row", "rule")


def judge(
    pages: DataFrame, rules: Sequence[Stated], min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, otherwise: str = "allow", id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(id, host, path, rule, verdict, mined, confidence) of each row; mined is the text of the mined rule that judged it, if one did."""
    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    placed = read.withColumns({"host": host, "path": path})
    rule, verdict = stated(F.col("host"), F.col("path"), rules)
    marked = placed.select("*", rule.alias("rule"), verdict.alias("label"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    marked = lasting(marked.withColumn("row", F.monotonically_increasing_id()))
    known = mine(marked.where("label IS NOT NULL"), min_support, min_confidence)
    fired = holding(marked.where("label IS NULL").select("row", "tokens"), known)
    text = F.array_join("rule.need", " ")
    order = F.struct("rule.confidence", "rule.support", -F.size("rule.need"), text.alias("text"), "rule.label")
    best = fired.groupBy("row").agg(F.max(order).alias("best")).select("row", "best.label", "best.text", "best.confidence")
    told = marked.where("label IS NULL").drop("label").join(best, "row", "left")
    columns = ["id", "host", "path", "rule", F.coalesce("label", F.lit(otherwise)).alias("verdict")]
    sure = marked.where("label IS NOT NULL").select(*columns, F.lit(None).cast("string").alias("mined"), F.lit(None).cast("double").alias("confidence"))
    return sure.unionByName(told.select(*columns, F.col("text").alias("mined"), "confidence"))
