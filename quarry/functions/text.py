"""Text functions: normalisers, identities, tokenizers, path and markup helpers (columns)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Words that carry no meaning in a question.
STOP_WORDS = "a an and are as at be by for from how in is it last of on or the to was what when where which why with want know".split()
#: Tags that hold or shape data and don't tell flows apart.
CONTAINER_TAGS = "screen actions script if else condition iterate set".split()
RESPONSE_TAGS = "default-response conditional-response error-response".split()


@pandas_udf(StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def identity_key(x: Column, compatibility: bool = True) -> Column:
    """Lower case, letters and numbers only.  With ``compatibility``, text beyond ASCII is
    first brought to NFKC (the only part that leaves the JVM)."""
    base = F.when(x.rlike(r"^\p{ASCII}*$"), x).otherwise(_nfkc(x)) if compatibility else x
    return F.regexp_replace(F.lower(base), r"[^\p{L}\p{N}]+", "")


def ascii_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def label_key(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def path_key(x: Column, lower: bool = False) -> Column:
    out = F.regexp_replace(F.regexp_replace(x, r"\\", "/"), r"^\./", "")
    return F.lower(out) if lower else out


def clip(x: Column, most: int, ellipsis: bool = True) -> Column:
    clean = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most), F.lit("…" if ellipsis else ""))).otherwise(clean)


def semantic_id(kind: Column, scope: Column, name: Column) -> Column:
    """kind:hash of kind, scope and the name's key; stable over runs."""
    return F.concat(kind, F.lit(":"), F.substring(F.sha1(F.concat_ws("|", kind, scope, identity_key(name, compatibility=False))), 1, 16))


def camel_words(x: Column) -> Column:
    """Lower-case words; case changes and everything but ASCII letters and digits split."""
    apart = F.regexp_replace(F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(apart), "[^a-z0-9]+"), lambda w: w != "")


def search_words(x: Column) -> Column:
    """Distinct lower-case words of two signs or more, stop words aside."""
    words = F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))
    return F.array_distinct(words)


def simple_name(x: Column) -> Column:
    return F.element_at(F.filter(F.split(x, r"[.#:/]"), lambda p: p != ""), -1)


def humanize(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2"), r"[_\-.]+", " "))


def attribute(markup: Column, name: str, any_case: bool = True) -> Column:
    return F.trim(F.regexp_extract(markup, rf"{'(?i)' if any_case else ''}\b{name}=[\"']([^\"']+)[\"']", 1))


def strip_tags(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " "))


def navigation_key(url: Column) -> Column:
    """The last path segment without query, fragment or .xml; a lone dot is self."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_extract(F.trim(url), r"^([^?#]*)", 1), r"\\", "/"), "/+$", "")
    last = F.element_at(F.concat(F.array(clean), F.filter(F.split(clean, "/"), lambda p: p != "")), -1)
    return F.when(clean == "", "").when(clean == ".", "self").otherwise(F.lower(F.regexp_replace(last, r"(?i)\.xml$", "")))


def _or(label: str, *values: Column) -> Column:
    """label:value with the first value that isn't empty; empty if none."""
    first = F.coalesce(*(F.when(v != "", v) for v in values), F.lit(""))
    return F.when(first != "", F.concat(F.lit(label), F.lower(first))).otherwise("")


def flow_token(signature: Column) -> Column:
    """What a step of a call path does, in one comparable token; containers give ''."""
    raw = F.trim(signature)
    tag = F.lower(F.regexp_extract(raw, r"^</?(?:[\w.-]+:)?([\w.-]+)", 1))
    name, entity = attribute(raw, "name"), attribute(raw, "entity-name")
    target = navigation_key(attribute(raw, "url"))
    else_tag = lambda c: F.when(c == "", tag).otherwise(c)
    by_entity = F.coalesce(*(F.when(v != "", v) for v in (entity, attribute(raw, "value-field"), name)), F.lit(""))
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", "")
        .when(~raw.startswith("<"), F.concat(F.lit("code:"), F.lower(F.regexp_replace(raw, r"\s+", " "))))
        .when(tag.isin(CONTAINER_TAGS), "")
        .when(tag.isin("transition", "transition-include"), else_tag(_or("transition:", name)))
        .when(tag == "service-call", else_tag(_or("service:", name)))
        .when(tag.isin(RESPONSE_TAGS), F.when(target != "", F.concat(F.lit("navigate:"), target)).otherwise(tag))
        .when(tag.startswith("entity-"), F.when(by_entity != "", F.concat(tag, F.lit(":"), F.lower(by_entity))).otherwise(tag))
        .when(tag == "subscreens-item", else_tag(_or("subscreen:", name, attribute(raw, "location"))))
        .otherwise(F.when(name != "", F.concat(tag, F.lit(":"), F.lower(name))).otherwise(tag))
    )


def evidence_files(x: Column) -> Column:
    """Distinct paths with a slash and an extension inside free text, in order."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"([\w.-]+(?:/[\w.-]+)+\.[A-Za-z0-9]+)"), 1))


def clamp01(x: Column) -> Column:
    """Into [0, 1]; null and non-finite values become 0."""
    v = x.cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def one_of(x: Column, allowed: list[str], otherwise: str) -> Column:
    return F.when(x.isin(allowed), x).otherwise(otherwise)


def line_number(text: Column, offset: Column) -> Column:
    """1-based line of a character offset."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n"))


def fingerprint(*columns: Column) -> Column:
    """A hash of a row's content, for skipping work that was already tried."""
    return F.sha1(F.to_json(F.struct(*columns)))
