"""URL filters: given rules for hosts and paths, and rules mined from labelled URLs by FP-growth.

A URL becomes a set of tokens: one for each of a fixed number of slots (scheme,
host labels, directories, ending, query names, fragment), and one for each
label and directory beyond these, however many. FP-growth finds the
combinations that labelled URLs hold often; those of which a large part is
blocked, more than of all URLs, become rules. A rule that adds tokens to
another without being surer is pruned. Rules are posted under each of their
tokens: a URL counts its tokens' postings, and a rule all of whose tokens are
there matches.

Ten slots have 1,023 combinations, but those of any number of further parts
would have no bound. So the sets of further parts are counted by their size
first, and only those go on that stand in fewer URLs than each smaller set in
them: with another set, any combination has the counts of a shorter one and
would be pruned. FP-growth then meets each URL once for each of its sets.
"""

from __future__ import annotations

import json
import math
from collections import Counter, defaultdict
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, stage, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host and path, verdict): a host's rule holds for its subdomains.
GIVEN = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Share of the labelled URLs that a combination needs, and at least so many of them: with fewer, chance alone makes rules.
LEAST_SUPPORT, LEAST_COUNT = 0.005, 25
#: Share of a rule's URLs that is blocked, and how many times that of all URLs.
LEAST_CONFIDENCE, LEAST_LIFT = 0.5, 1.5
#: The item of a blocked URL.
BLOCKED = "=block"
#: Begins the item of a set of further parts.
SET = "=parts "
#: Host labels from the right and directories that have a slot; those beyond are further parts.
HOST_SLOTS, PATH_SLOTS = 4, 2


def parts(url: Column) -> tuple[Column, Column]:
    """host and path: both empty without a URL or without ://."""
    text = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(text, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def given_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """The longest rule that fits, of equally long ones that with the longer host: a struct of rule and verdict, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0].find("/"))):
        name, begin = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(begin))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def masked(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]+", "0")


def parted(host: Column, path: Column) -> tuple[Column, Column]:
    """Host labels from the right, and directories."""
    return F.reverse(F.split(host, r"\.")), F.filter(F.split(path, "/"), lambda x: x != "")


def tokens(url: Column, host: Column, path: Column) -> Column:
    """All tokens of a URL."""
    return F.concat(slotted(url, host, path), further(host, path))


def further(host: Column, path: Column) -> Column:
    """The tokens of the labels and directories that have no slot, sorted."""
    labels, folders = parted(host, path)
    past = lambda all_, slots: F.slice(all_, slots + 1, F.size(all_))
    named = lambda name, slots: lambda x, k: F.concat(F.lit(name), (k + slots).cast("string"), F.lit(" "), x)
    found = F.concat(F.transform(past(labels, HOST_SLOTS), named("host", HOST_SLOTS)), F.transform(past(folders, PATH_SLOTS), lambda x, k: named("path", PATH_SLOTS)(masked(x), k)))
    return F.when(host != "", F.array_sort(found)).otherwise(F.array().cast("array<string>"))


def slotted(url: Column, host: Column, path: Column) -> Column:
    """The tokens of a URL's slots, one at most for each; runs of digits are one token, names of query fields are sorted."""
    text = F.coalesce(url, F.lit(""))
    labels, folders = parted(host, path)
    query = F.regexp_extract(text, r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"(?s)^([^=]*)", 1)), lambda x: x != "")))
    slots = [F.concat(F.lit("scheme "), F.translate(F.regexp_extract(text, r"(?s)^(.*?)://", 1), UPPER, LOWER))]
    slots += [F.concat(F.lit(f"host{k} "), F.get(labels, F.lit(k))) for k in range(HOST_SLOTS)]
    slots += [F.concat(F.lit(f"path{k} "), masked(F.get(folders, F.lit(k)))) for k in range(PATH_SLOTS)]
    slots.append(F.concat(F.lit("ending "), F.nullif(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1), F.lit(""))))
    slots.append(F.when(F.size(names) > 0, F.concat(F.lit("query "), F.array_join(names, " "))))
    slots.append(F.concat(F.lit("fragment "), F.nullif(masked(F.regexp_extract(text, r"(?s)#(.*)$", 1)), F.lit(""))))
    return F.when(host != "", F.filter(F.array(*slots), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and blocked of the pages that labels judges, each pair once.

    A page whose id has a label is blocked if one of its labels calls it toxic
    or of low quality.
    """
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")
    judged = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(bad).alias("blocked"))
    return pages.select(F.col("page_id").alias("doc_id"), "url").join(judged, "doc_id").select("url", "blocked").distinct()


def mine(spark: SparkSession, examples: DataFrame, support: float = LEAST_SUPPORT, count: int = LEAST_COUNT, confidence: float = LEAST_CONFIDENCE, lift: float = LEAST_LIFT) -> list[tuple]:
    """The rules of examples (url, blocked 0 or 1): (tokens, confidence, support), surest first.

    Then come those of larger support, then shorter ones, then by their tokens.
    URLs without a host are no examples. Of the ten slots' tokens alone no more
    than 1,023 / support rules exist, and as many for each set of further parts
    that `part_sets` keeps, whatever the number of examples; they are brought to
    the driver.
    """
    host, path = parts(F.col("url"))
    made = examples.select(slotted(F.col("url"), host, path).alias("tokens"), further(host, path).alias("further"), "blocked", F.monotonically_increasing_id().alias("id"))
    items = stage(spark, made.filter(F.size("tokens") > 0), "examples")
    n, blocked, most = items.agg(F.count("*"), F.sum("blocked"), F.max(F.size("further"))).first()
    if not n or not blocked:
        return []
    least = max(support, count / n)
    if least > 1:
        return []
    needed = math.ceil(least * n)

    def grown(baskets: DataFrame, least: float) -> DataFrame:
        """The sure combinations of baskets' tokens: antecedent, confidence and share of the baskets that hold it and are blocked."""
        whole = F.when(F.col("blocked") == 1, F.array_append("tokens", F.lit(BLOCKED))).otherwise(F.col("tokens"))
        model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=confidence).fit(baskets.select(whole.alias("items")))
        # Spark's lift is over the baskets; where URLs have several, theirs is meant.
        sure = model.associationRules.filter((F.col("consequent")[0] == BLOCKED) & (F.col("confidence") / (blocked / n) >= lift))
        return sure.select("antecedent", "confidence", "support")

    found = [(tuple(sorted(r["antecedent"])), r["confidence"], r["support"]) for r in grown(items, least).collect()]
    sets = part_sets(spark, items, needed) if most else None
    if sets is not None:
        # Each basket has one set of further parts as one item, so a combination with it counts URLs.
        baskets = stage(spark, items.join(sets, "id").select(F.array_append("tokens", F.concat(F.lit(SET), F.to_json("parts"))).alias("tokens"), "blocked"), "baskets")
        times = baskets.count()
        for r in grown(baskets, (needed - 0.5) / times).filter(F.exists("antecedent", lambda x: F.startswith(x, F.lit(SET)))).collect():
            slots = [x for x in r["antecedent"] if not x.startswith(SET)]
            more = next(json.loads(x[len(SET) :]) for x in r["antecedent"] if x.startswith(SET))
            found.append((tuple(sorted(slots + more)), r["confidence"], round(r["support"] * times) / n))
    return pruned(sorted(found, key=lambda r: (-r[1], -r[2], len(r[0]), r[0])))


def part_sets(spark: SparkSession, items: DataFrame, needed: int) -> DataFrame | None:
    """id and parts: the sets of further parts that each of items (id, further, blocked) holds; None without any.

    A set stands in so many blocked URLs as needed, and in fewer URLs than any
    smaller set in it. All sets in such a one are such, too, so those of a size
    are made from those that are smaller by one.
    """
    held = items.select("id", "blocked", F.explode("further").alias("part")).select("id", "blocked", F.array("part").alias("parts"))
    smaller, levels = None, []
    while True:
        counted = held.groupBy("parts").agg(F.count("*").alias("n"), F.sum("blocked").alias("b")).filter(F.col("b") >= needed)
        if smaller is not None:
            less = F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda out: F.filter("parts", lambda x, k: k != out))
            inside = counted.select("parts", "n", F.explode(less).alias("less")).join(smaller.select(F.col("parts").alias("less"), F.col("n").alias("of_less")), "less")
            inside = inside.groupBy("parts", "n").agg(F.count("*").alias("all"), F.min("of_less").alias("least"))
            counted = inside.filter((F.col("all") == F.size("parts")) & (F.col("least") > F.col("n"))).select("parts", "n")
        smaller = stage(spark, counted.select("parts", "n"), "part_sets")
        if smaller.isEmpty():
            break
        held = stage(spark, held.join(smaller.select("parts"), "parts").select("id", "blocked", "parts"), "held_sets")
        levels.append(held.select("id", "parts"))
        # Two sets that differ in their last part make one that is larger by one.
        begin, last = F.slice("parts", 1, F.size("parts") - 1), F.element_at("parts", -1)
        more = held.select("id", begin.alias("begin"), last.alias("more"))
        held = held.select("id", "blocked", "parts", begin.alias("begin"), last.alias("last")).join(more, ["id", "begin"]).filter(F.col("last") < F.col("more"))
        held = held.select("id", "blocked", F.array_append("parts", F.col("more")).alias("parts"))
    return reduce(DataFrame.union, levels) if levels else None


class Postings:
    """Rules by their tokens."""

    def __init__(self, rules: Iterable[tuple] = ()):
        self.rules: list[tuple] = []
        self.lists: dict[str, list[int]] = defaultdict(list)
        for rule in rules:
            self.add(rule)

    def add(self, rule: tuple) -> None:
        for token in rule[0]:
            self.lists[token].append(len(self.rules))
        self.rules.append(rule)

    def first(self, found: Iterable[str]) -> tuple | None:
        """The first rule all of whose tokens are among these."""
        met = Counter(k for token in set(found) for k in self.lists.get(token, ()))
        whole = [k for k, times in met.items() if times == len(self.rules[k][0])]
        return self.rules[min(whole)] if whole else None


def pruned(rules: list[tuple]) -> list[tuple]:
    """Without the rules that a rule before them, of fewer tokens, already covers."""
    kept = Postings()
    for rule in rules:
        if kept.first(rule[0]) is None:
            kept.add(rule)
    return kept.rules


def judge(spark: SparkSession, pages: DataFrame, rules: list[tuple], given: Iterable[tuple[str, str]] = GIVEN) -> DataFrame:
    """pages with host, path, rule (the given rule that fits, else null), verdict, mined (the mined rule's tokens) and confidence.

    A given rule decides; else a mined rule blocks, and what no rule meets is
    allowed, such as null URLs and those without ://, whose host and path are
    empty. Columns of pages that have one of the new names give way; repeated
    rows stay; an empty table gives an empty one.
    """
    ship(spark)
    host, path = parts(F.col("url"))
    new = ("host", "path", "rule", "verdict", "mined", "confidence")
    box = unused(["url"], "page")
    kept = [c for c in pages.columns if c.lower() not in new]
    # Rules have a proven bound, whatever the input.
    held = spark.sparkContext.broadcast(rules)

    @F.pandas_udf("mined string, confidence double")
    def matched(found: pd.Series) -> pd.DataFrame:
        from loomtab.llm import url_filter as u

        postings = u.Postings(held.value)
        best = [postings.first(t) for t in found]
        return pd.DataFrame({"mined": [" & ".join(b[0]) if b else None for b in best], "confidence": [b[1] if b else None for b in best]})

    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias(box), host.alias("host"), path.alias("path"), F.col("url"))
    rows = rows.select(box, "host", "path", given_rule(F.col("host"), F.col("path"), given).alias("fits"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    rows = rows.withColumn("best", matched("tokens"))
    verdict = F.when(F.col("fits").isNotNull(), F.col("fits.verdict")).when(F.col("best.mined").isNotNull(), "block").otherwise("allow")
    return rows.select(*[F.col(box)[c].alias(c) for c in kept], "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"), "best.mined", "best.confidence")
