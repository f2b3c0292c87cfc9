"""Lexical search over lines, symbols and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.arrays import contiguous_at, ordered_matches
from quarry.functions.text import camel_words, clip, search_words


def line_search(files: DataFrame, terms: list[str], most: int = 8, snippet: int = 220) -> DataFrame:
    """Lines that hold every term (the path counts), first files first.
    files: path, text."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    here = F.lower(F.concat_ws(" ", "path", "line"))
    ok = F.lit(True)
    for t in terms:
        ok &= F.contains(here, F.lit(t.lower()))
    return lines.where(ok).select("path", (F.col("at") + 1).alias("line_no"), clip(F.col("line"), snippet, ellipsis=False).alias("snippet")).orderBy("path", "line_no").limit(most)


def symbol_search(symbols: DataFrame, terms: list[str], most: int = 12) -> DataFrame:
    """5 for each term in the header, 1 for each in the body.  symbols: id, header, body."""
    score = F.lit(0)
    for t in terms[:8]:
        score += F.when(F.contains(F.lower("header"), F.lit(t.lower())), 5).otherwise(0) + F.when(F.contains(F.lower("body"), F.lit(t.lower())), 1).otherwise(0)
    return symbols.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(most)


def tier_of(target: Column, query: Column) -> tuple[Column, Column]:
    """(tier, words matched): 5 exact, 4 at the beginning, 3 in one piece, 2 in order,
    1 some in order, 0 none."""
    at, ordered = contiguous_at(target, query), ordered_matches(target, query)
    n = F.size(query)
    tier = F.when((n == 0) | (F.size(target) == 0), 0).when((at == 0) & (F.size(target) == n), 5).when(at == 0, 4).when(at > 0, 3).when(ordered == n, 2).when(ordered > 0, 1).otherwise(0)
    return tier, F.when(tier >= 2, n).when(tier == 1, ordered).otherwise(0)


def tiered_search(names: DataFrame, query: str, most: int = 12) -> DataFrame:
    """names: id, name."""
    words = camel_words(F.lit(query))
    tier, matched = tier_of(camel_words(F.col("name")), words)
    return names.select("id", "name", tier.alias("tier"), matched.alias("matched")).where("tier > 0").orderBy(F.desc("tier"), F.desc("matched"), "name", "id").limit(most)


def lexical_score(query: str, text: Column) -> Column:
    """Share of query words that a text's words match (either a beginning of the other, of
    four signs at least), plus 0.8 if it holds the whole query."""
    candidate, q = search_words(text), search_words(F.lit(query))

    def matches(x: Column) -> Column:
        return F.exists(candidate, lambda c: (c == x) | ((F.length(x) >= 4) & c.startswith(x)) | ((F.length(c) >= 4) & x.startswith(c)))

    phrase = F.when(F.contains(F.lower(text), F.lit(query.strip().lower())), 0.8).otherwise(0.0)
    return F.when((F.size(q) == 0) | (F.size(candidate) == 0), 0.0).otherwise(F.size(F.filter(q, matches)) / F.size(q) + phrase)


def ranked_search(rows: DataFrame, query: str, text: Column, *ties, most: int = 12) -> DataFrame:
    return rows.withColumn("score", lexical_score(query, text)).where("score > 0").orderBy(F.desc("score"), *ties).limit(most)


def match_preview(tokens: DataFrame, matched: Column, keys: list[str], around: int = 1) -> DataFrame:
    """Tokens within ``around`` of a match, and whether a gap lies before each.
    tokens: keys, pos, token."""
    w = Window.partitionBy(*keys).orderBy("pos")
    near = F.max(F.when(matched, 1).otherwise(0)).over(w.rowsBetween(-around, around))
    kept = tokens.withColumn("_near", near).where("_near = 1").drop("_near")
    return kept.withColumn("gap_before", F.coalesce(F.col("pos") - F.lag("pos").over(w) > 1, F.lit(False)))


def _matches(candidate: Column, wanted: list[str]) -> Column:
    """Whether a word list has a word that begins like a wanted one, or the other way round."""
    hit = lambda q: F.exists(candidate, lambda c: (c == q) | ((F.length(c) >= 4) & F.lit(q).startswith(c)) | (c.startswith(q) if len(q) >= 4 else F.lit(False)))
    out = F.lit(False)
    for q in wanted:
        out |= hit(q)
    return out


def path_previews(paths: DataFrame, keys: list[str], wanted: list[str], most: int = 13, first: int = 5) -> DataFrame:
    """(keys, preview): tokens beside those that match a wanted word, with an ellipsis at each
    gap and where more follow, ``most`` items; where none matches, the ``first`` tokens.
    Only so many rows of a path meet in one.  paths: keys, tokens."""
    tokens = paths.select(*keys, F.size("tokens").alias("n"), F.posexplode("tokens").alias("pos", "token"))
    near = match_preview(tokens, _matches(search_words(F.col("token")), wanted), keys)
    k = F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    few = near.withColumn("k", k).where(F.col("k") <= most + 1)
    rows = F.array_sort(F.collect_list(F.struct("pos", "gap_before", clip(F.col("token"), 160, ellipsis=False).alias("token"))))
    held = few.groupBy(*keys, "n").agg(rows.alias("r"))
    gap, none = F.array(F.lit("…")), F.array().cast("array<string>")
    items = F.flatten(F.transform("r", lambda x: F.concat(F.when(x.gap_before, gap).otherwise(none), F.array(x.token))))
    more = F.when(F.element_at("r", -1).pos < F.col("n") - 1, gap).otherwise(none)
    found = held.select(*keys, F.slice(F.concat(items, more), 1, most).alias("found"))
    return paths.join(found, keys, "left").select(*keys, F.coalesce("found", F.slice("tokens", 1, first)).alias("preview"))


def term_count(rows: DataFrame, terms: list[str], most: int = 12) -> DataFrame:
    """(id, score) of rows whose JSON holds the terms (eight at most), one point each."""
    text = F.lower(F.to_json(F.struct(*(c for c in rows.columns if c != "id"))))
    score = sum((F.when(F.contains(text, F.lit(t.lower())), 1).otherwise(0) for t in terms[:8]), F.lit(0))
    return rows.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(most)


#: Words that a question's theme adds to its own.
THEMES = {
    "sell|sales|sold|revenue": ["order", "item", "quantity", "amount", "total", "price"],
    "region|location|geograph|state|country": ["region", "state", "country", "geo", "address", "postal", "contact"],
    "product|item": ["product", "item"],
    "customer|buyer": ["customer", "party"],
}
#: Names of identifying fields, and of measures and places.
ID_NAMES = "orderid|productid|partyid|contactmechid|seqid|geoid"
MEASURE_NAMES = "quantity|amount|total|price|date|status|region|state|country|geo|address|postal"


def question_terms(question: Column) -> Column:
    """Words of three signs or more, and those of the themes that the question touches."""
    q = F.lower(question)
    own = F.filter(F.split(q, "[^a-z0-9]+"), lambda w: F.length(w) > 2)
    themes = [F.when(q.rlike(p), F.array(*map(F.lit, words))).otherwise(F.array().cast("array<string>")) for p, words in THEMES.items()]
    return F.array_distinct(F.concat(own, *themes))


def field_score(name: Column, description: Column, is_key: Column, terms: Column) -> Column:
    """How useful a field is for a question: keys, its words, and telling names."""
    text = F.lower(F.concat_ws(" ", name, description))
    hits = F.size(F.filter(terms, lambda t: F.contains(text, t)))
    return F.when(is_key, 5).otherwise(0) + 3 * hits + F.when(F.lower(name).rlike(ID_NAMES), 3).otherwise(0) + F.when(text.rlike(MEASURE_NAMES), 2).otherwise(0)


def top_fields(fields: DataFrame, question: str, most: int = 18) -> DataFrame:
    """The best fields of each entity.  fields: entity, field, description, is_pk."""
    scored = fields.withColumn("score", field_score(F.col("field"), F.coalesce("description", F.lit("")), F.col("is_pk"), question_terms(F.lit(question))))
    w = Window.partitionBy("entity").orderBy(F.desc("score"), "field")
    return scored.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
