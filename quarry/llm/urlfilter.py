"""URL filtering by a rule list and by association rules mined from labels.

A rule list of (host, path) pairs decides first: a rule fits its host and all subdomains
if the path starts with the rule's; the longest rule wins.  Other URLs are judged by rules
that Spark's FP-growth mines from labelled URLs: combinations of URL tokens that imply a
block label with enough support, confidence and lift.  A mined rule is dropped where one
with fewer tokens holds, for that one decides the same URLs.  An inverted index (rarest token of each rule
to the rule) finds the rules that a URL fits without trying all of them.

Mining loses no combination.  Tokens that the same labelled URLs hold are one item (any of them
stands for it), so a long path that many URLs share is one item.  An item that is a rule by itself
needs no longer ones.  FP-growth sees the blocked URLs of up to ``widest`` other items, for a
rule's support is theirs; the combinations of wider URLs, which it would take in all lengths, are
exploded up to the length of a rule.  A combination with enough support overall has its share of it
in one of the two parts, so both give candidates, which are then counted in all labelled URLs by
a join.  A rule has ``longest`` items at most: that is what a rule is, not a bound of the search.

Edge cases: a null URL, or one without ``://``, has an empty host and path, no tokens and
is allowed; equal URLs get equal verdicts; with no labels or only one kind of label nothing
is mined; other columns are ignored.
"""

from __future__ import annotations

import string
from functools import reduce
from itertools import combinations, islice
from math import ceil

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.runtime import materialise

BLOCK, ALLOW = "block", "allow"


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Host, its parts, the words of the path and the names in the query."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    words = F.filter(F.split(F.lower(path), r"[/._~%+-]+"), lambda x: (x != "") & ~x.rlike(r"^\p{N}+$"))
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    every = F.concat(
        F.array(F.concat(F.lit("host="), host), F.concat(F.lit("domain="), domain), F.concat(F.lit("sub="), labels[0])),
        F.transform(words, lambda x: F.concat(F.lit("path="), x)),
        F.transform(names, lambda x: F.concat(F.lit("query="), x)),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; rules: (host, path, verdict)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, what in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def least_share(hits: int | Column, n: int | Column, z: float = 1.645) -> float | Column:
    """The lower end of Wilson's interval for a share of hits in n, at 95 %."""
    p = hits / n
    return (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)


def items_of(urls: DataFrame, least: float) -> DataFrame:
    """(token, item, n, hits) of tokens in ``least`` URLs or more: tokens of the same URLs
    share an item, the least of them.  urls: (url, tokens, blocked)."""
    each = urls.select(F.col("blocked").cast("int").alias("hit"), F.xxhash64(F.monotonically_increasing_id()).alias("row"), F.explode("tokens").alias("token"))
    marks = each.groupBy("token").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.expr("bit_xor(row)").alias("x"), F.sum(F.shiftright("row", 32)).alias("s"))
    same = marks.where(F.col("n") >= least).groupBy("n", "hits", "x", "s").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens"))
    return same.select(F.explode("tokens").alias("token"), "item", "n", "hits")


Rules = list[tuple[tuple[str, ...], float]]


def subsets(batches, shortest: int, longest: int):
    """The combinations of a row's items, beside the row's other columns."""
    for batch in batches:
        rest = [c for c in batch.schema.names if c != "items"]
        for k, items in enumerate(batch.column("items").to_pylist()):
            every = (list(c) for n in range(shortest, min(longest, len(items)) + 1) for c in combinations(items, n))
            while some := list(islice(every, 20_000)):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.list_(pa.int32())), *(pa.array([batch.column(c)[k].as_py()] * len(some), batch.column(c).type) for c in rest)], names=["items", *rest])


def mine(
    urls: DataFrame, support: float = 0.002, least: int = 8, confidence: float = 0.5, sure: float = 0.5, lift: float = 1.5, longest: int = 4, widest: int = 12
) -> tuple[Rules, dict[str, str]]:
    """Item combinations that imply the block label, and the items of tokens; urls: (tokens,
    blocked).

    A rule must hold in ``support`` of the labelled URLs and in ``least`` of them; of the
    URLs with its items ``confidence`` must be blocked, with a lower bound at 95 % of
    ``sure``, and ``lift`` times the share of all URLs.  No rule is part of another."""
    urls = materialise(urls.where(F.size("tokens") > 0).select("tokens", "blocked"), "urls")
    known, blocked = urls.agg(F.count("*"), F.coalesce(F.sum(F.col("blocked").cast("int")), F.lit(0))).first()
    if known < least or not 0 < blocked < known:
        return [], {}
    need = max(support * known, least)
    n, hits = F.col("n"), F.col("hits")
    holds = (hits >= need) & (hits >= confidence * n) & (least_share(hits, n) >= sure) & (hits * known >= lift * blocked * n)
    rows = items_of(urls, need).where(hits >= need).withColumn("holds", holds).collect()  # at most a URL's tokens / support
    item = {r.token: r.item for r in rows}
    alone = {r.item: r.hits / r.n for r in rows if r.holds}
    # Numbers by rareness: the first item of a combination is in the fewest URLs.
    names = [i for _, i in sorted({(r.n, r.item) for r in rows if not r.holds})]
    number = {name: k for k, name in enumerate(names)}
    numbers = {t: number[i] for t, i in item.items() if i in number}

    def transactions(batches):
        for batch in batches:
            held = [sorted({numbers[t] for t in tokens if t in numbers}) for tokens in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.int32())), batch.column("blocked")], names=["items", "blocked"])

    held = materialise(urls.mapInArrow(transactions, "items array<int>, blocked boolean").where(F.size("items") > 1), "held")
    narrow = F.size("items") <= widest
    few, many = held.where("blocked").agg(F.count_if(narrow), F.count_if(~narrow)).first()
    if few + many < need:
        return sorted(((i,), share) for i, share in alone.items()), item
    # Rows that a part must have of a combination with ``need`` in both, just above which no whole number lies.
    share = lambda part: max(1, ceil(need * part / (few + many) * (1 - 1e-12)))
    found = []
    if few:
        sets = FPGrowth(itemsCol="items", minSupport=(share(few) - 0.5) / few).fit(held.where(F.col("blocked") & narrow).select("items")).freqItemsets
        found.append(sets.where(F.size("items").between(2, longest)).select(F.array_sort("items").alias("items")))
    if many:
        wide = held.where(F.col("blocked") & ~narrow).select("items").mapInArrow(lambda batches: subsets(batches, 2, longest), "items array<int>")
        found.append(wide.groupBy("items").count().where(F.col("count") >= share(many)).select("items"))
    candidates = reduce(DataFrame.unionByName, found).distinct().select(F.col("items").alias("rule"), F.col("items")[0].alias("at"))
    kinds = held.groupBy("items").agg(F.count("*").alias("n"), F.count_if("blocked").alias("hits")).withColumn("at", F.explode("items"))
    fits = candidates.join(kinds, "at").where(F.forall("rule", lambda i: F.array_contains("items", i)))
    good = materialise(fits.groupBy("rule").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).where(holds).select(F.col("rule").alias("items"), "rule", (hits / n).alias("share")), "rules")
    # A rule that holds a shorter one says nothing that the shorter one doesn't.
    parts = good.select("items", "rule").mapInArrow(lambda batches: subsets(batches, 2, longest - 1), "items array<int>, rule array<int>").where(F.size("items") < F.size("rule"))
    needless = parts.join(good.select("items"), "items", "left_semi").select("rule").distinct()
    shortest = good.join(needless, "rule", "left_anti").select("rule", "share").collect()
    return prune([((i,), share) for i, share in alone.items()] + [(tuple(sorted(names[i] for i in r["rule"])), r["share"]) for r in shortest]), item


def fitting(index: dict[str, list[frozenset]], own: set[str]) -> list[frozenset]:
    """The rules whose items are all among ``own``."""
    return [r for t in own for r in index.get(t, ()) if r <= own]


def prune(rules: Rules) -> Rules:
    """Without rules that a shorter one, at least as confident, makes needless."""
    kept: dict[frozenset, float] = {}
    for tokens, sure in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own = frozenset(tokens)
        parts = (frozenset(c) for n in range(1, len(own)) for c in combinations(tokens, n))
        if not any(kept.get(part, -1.0) >= sure for part in parts):
            kept[own] = sure
    return sorted((tuple(sorted(k)), v) for k, v in kept.items())


def inverted_index(rules: Rules) -> dict[str, list[frozenset]]:
    """Each rule under that of its tokens which the fewest rules hold."""
    count: dict[str, int] = {}
    for tokens, _ in rules:
        for t in tokens:
            count[t] = count.get(t, 0) + 1
    index: dict[str, list[frozenset]] = {}
    for tokens, _ in rules:
        index.setdefault(min(tokens, key=lambda t: (count[t], t)), []).append(frozenset(tokens))
    return index


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], **mining) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; narrow over the pages."""
    url = F.col("url").cast("string")
    typed = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"))
    marks = labels.where("quality IS NOT NULL OR toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.coalesce(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)), F.lit(False)).alias("blocked"))
    seen = typed.join(marks, "page_id").select(tokens_of(F.col("url")).alias("tokens"), "blocked")
    found, item = mine(seen, **mining)
    index = inverted_index(found)

    def run(batches):
        for batch in batches:
            said = []
            for ruled, tokens in zip(batch.column("verdict").to_pylist(), batch.column("tokens").to_pylist()):
                if ruled is None:
                    ruled = BLOCK if fitting(index, {item[t] for t in tokens or () if t in item}) else ALLOW
                said.append(ruled)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("page_id", "host", "path", "rule")] + [pa.array(said, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_columns(host, path, rules)
    parts = typed.select("page_id", host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("verdict"), tokens_of(F.col("url")).alias("tokens"))
    return parts.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
