"""Extraction of symbols, references, markup, schemas and settings from source text.

Markup is read once as a list of tags; one pass nests them, and every form (hierarchy,
executable steps, schemas, units) is a view of the nested list.  Braced blocks end where the
running sum over their marks returns to zero.  What regular expressions can say stays in the
JVM; the rest runs in Arrow batches, one document after the other.

Edge cases: null paths and texts are empty; an empty text has no rows; unbalanced braces and
elements that never close run to the text's end or to a bounded length, as stated.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterable
from itertools import accumulate, chain
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.knowledge import MARKUP_REFERENCES

#: Words before a parenthesis that aren't functions, or aren't calls; how much
#: is kept of a block that has no end.
KEYWORDS = frozenset("if for while switch catch".split())
NOT_CALLS = KEYWORDS | frozenset("return new typeof".split())
FALLBACK = 2600

# Blocks -----------------------------------------------------------------------------------

_MARKS = re.compile(r"\"(?:\\.|[^\"\\])*(?:\"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)|[{}]", re.S)


def braces_end(text: str, start: int) -> int:
    """End of the balanced block that begins at or after ``start``, quoted text aside; the
    text's end where it never closes, ``FALLBACK`` signs on where none begins."""
    first = text.find("{", start)
    if first < 0:
        return min(len(text), start + FALLBACK)
    marks = [m for m in _MARKS.finditer(text, first) if m[0] in "{}"]
    depths = accumulate(1 if m[0] == "{" else -1 for m in marks)
    return next((m.end() for m, depth in zip(marks, depths) if depth == 0), len(text))


def indent_end(text: str, start: int) -> int:
    """End of an indented block: the next line with text that is indented no deeper."""
    line = re.compile(r"[^\n]*").match(text, start)
    width = len(line[0]) - len(line[0].lstrip())
    shallow = re.compile(rf"\n(?=[ \t\r\f\v]{{0,{width}}}[^\s])").search(text, line.end())
    return shallow.start() if shallow else len(text)


_NAME = r"(?P<name>[A-Za-z_$][\w$]*)"
_ARGUMENTS = r"\((?P<args>[^)]*)\)"
#: By language, the heads that begin a symbol: (kind, pattern), matched at a line's beginning.
HEADS = {
    "python": [("function", rf"(?:async[ \t]+)?def[ \t]+{_NAME}[ \t]*{_ARGUMENTS}[^:\n]*:")],
    "braces": [
        ("function", rf"(?:(?:export|default|async)\s+)*function\s+{_NAME}\s*{_ARGUMENTS}"),
        ("function", rf"(?:export\s+)?(?:var|let|const)\s+{_NAME}\s*=\s*(?:async\s*)?{_ARGUMENTS}\s*=>"),
        ("method", rf"(?:[a-z]+[ \t]+)*(?:[\w<>\[\],.?]+[ \t]+)?{_NAME}[ \t]*{_ARGUMENTS}[ \t]*(?:throws[ \t]+[^{{\n]+)?\{{"),
    ],
}
_HEADS = {language: [(kind, re.compile(r"^[ \t]*" + p, re.M)) for kind, p in heads] for language, heads in HEADS.items()}


def line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def code_symbols(path: str, text: str) -> Iterable[tuple]:
    """(path, name, kind, signature, start_line, end_line, body) of functions and methods; a
    name counts once where it begins."""
    language, end_of = ("python", indent_end) if path.lower().endswith(".py") else ("braces", braces_end)
    found = {}
    for kind, head in _HEADS[language]:
        for m in head.finditer(text):
            if m["name"] not in KEYWORDS:
                found.setdefault((m["name"], m.start()), (kind, m[0]))
    for (name, start), (kind, head) in found.items():
        end = end_of(text, start)
        yield path, name, kind, head.strip()[:280], line_of(text, start), line_of(text, end), text[start:end]


# Markup -----------------------------------------------------------------------------------


class Tag(NamedTuple):
    name: str
    attributes: dict[str, str]
    start: int
    stop: int
    closes: bool
    alone: bool


_TAG = re.compile(r"<\s*(?P<slash>/)?\s*(?P<name>[^\s<>/?!][^\s>]*?)(?P<rest>(?:\s[^>]*?)?)(?P<alone>/)?\s*>")
_ATTRIBUTE = re.compile(r"(?P<key>[\w:.-]+)\s*=\s*(?P<quote>[\"'])(?P<value>.*?)(?P=quote)", re.S)


def tags(text: str) -> list[Tag]:
    return [Tag(m["name"], {a["key"]: a["value"] for a in _ATTRIBUTE.finditer(m["rest"])} if m["rest"] else {}, m.start(), m.end(), bool(m["slash"]), bool(m["alone"])) for m in _TAG.finditer(text)]


def nest(found: list[Tag]) -> tuple[list[Tag], list[int], list[int], list[int | None]]:
    """(opening tags, the index of each one's parent or -1, its depth, where it closes).  An
    end tag closes the nearest open element of its name and all inside it; others mean
    nothing."""
    nodes, parents, depths, ends = [], [], [], []
    chain: list[int] = []
    places: dict[str, list[int]] = defaultdict(list)  # depths at which a name is open
    for t in found:
        here = places[t.name]
        while here and (here[-1] >= len(chain) or nodes[chain[here[-1]]].name != t.name):
            here.pop()  # closed since, with something around it
        if t.closes:
            if here:
                ends[chain[here[-1]]] = t.stop
                del chain[here.pop() :]
            continue
        parents.append(chain[-1] if chain else -1)
        depths.append(len(chain))
        ends.append(t.stop if t.alone else None)
        nodes.append(t)
        if not t.alone:
            here.append(len(chain))
            chain.append(len(nodes) - 1)
    return nodes, parents, depths, ends


def markup_tree(path: str, text: str) -> Iterable[tuple]:
    """(path, ordinal, tag, parent, depth, start, end, attributes) of a tag soup, numbered
    from 1; attribute values are cut at 180 signs."""
    for k, (t, p, depth, end) in enumerate(zip(*nest(tags(text))), 1):
        yield path, k, t.name, p + 1 or None, depth, t.start, end, [(a, v[:180]) for a, v in t.attributes.items()]


def local(name: str) -> str:
    return name.rpartition(":")[2]


def first(attributes: dict[str, str], *names: str) -> str:
    """The first of the attributes that has a value."""
    return next((attributes[n] for n in names if attributes.get(n)), "")


#: Tags that run, in the order of the markup's vocabulary.
EXECUTABLE = frozenset(
    "screen transition transition-include actions condition if else iterate service-call entity-find entity-find-count entity-one entity-create entity-update entity-delete set script default-response conditional-response error-response subscreens-item".split()
)


def nearest_flagged(parents: list[int], flagged: list[bool]) -> list[int]:
    """For each node its nearest flagged ancestor, or -1; parents come before children."""
    out: list[int] = []
    for p in parents:
        out.append(p if p < 0 or flagged[p] else out[p])
    return out


def executable(path: str, text: str) -> Iterable[tuple]:
    """(path, ordinal, tag, parent, line, identity, attributes) of tags that run, numbered
    from 1; the parent is the nearest ancestor that runs."""
    nodes, parents, *_ = nest(tags(text))
    runs = [local(t.name) in EXECUTABLE for t in nodes]
    number = [n if r else None for n, r in zip(accumulate(map(int, runs)), runs)]
    for t, n, p in zip(nodes, number, nearest_flagged(parents, runs)):
        if n:
            identity = first(t.attributes, "name", "entity-name", "url", "location", "field", "field-name")
            yield path, n, local(t.name), number[p] if p >= 0 else None, line_of(text, t.start), identity, list(t.attributes.items())


#: Tags that are named symbols, and tags that are units of meaning with the
#: relation and attribute of what they refer to.
NAMED = ("service", "transition", "screen", "actions", "script", "condition")
UNITS = {
    "service-call": ("calls", "name"),
    "entity-find": ("reads", "entity-name"),
    "entity-find-count": ("reads", "entity-name"),
    "entity-one": ("reads", "entity-name"),
    "transition": ("routes_to", "name"),
    **dict.fromkeys("set if iterate section section-iterate subscreens-item service screen actions script condition".split()),
}


def element_end(text: str, tag: Tag) -> int:
    """End of an element at the first end tag of its name, nested ones or not; ``FALLBACK``
    signs on where there is none."""
    if tag.alone:
        return tag.stop
    close = f"</{tag.name}>"
    at = text.find(close, tag.stop)
    return at + len(close) if at >= 0 else min(len(text), tag.start + FALLBACK)


def named_markup(path: str, text: str) -> Iterable[tuple]:
    """Symbols like those of ``code_symbols`` for named elements; a service with a verb or a
    noun is called verb#noun."""
    for t in tags(text):
        if t.closes or t.name not in NAMED:
            continue
        a = t.attributes
        name = "#".join(x for x in (a.get("verb"), a.get("noun")) if x) if t.name == "service" else ""
        if name := name or first(a, "name", "id"):
            end = element_end(text, t)
            yield path, name, t.name, text[t.start : t.stop][:280], line_of(text, t.start), line_of(text, end), text[t.start : end]


def units(path: str, text: str) -> Iterable[tuple]:
    """(path, ordinal, tag, name, line, attributes, reference, relation) of tags with a
    meaning of their own."""
    found = [t for t in tags(text) if not t.closes and local(t.name) in UNITS]
    for k, t in enumerate(found, 1):
        tag, a = local(t.name), t.attributes
        relation, key = UNITS[tag] or (None, "")
        target = a.get(key) or None
        name = first(a, "name", "entity-name", "field", "field-name") or f"{tag}-{k}"
        yield path, k, tag, name, line_of(text, t.start), list(a.items()), target, relation if target else None


_ENTITY = ("entity", "view-entity", "extend-entity")


def entity_schemas(path: str, text: str) -> Iterable[tuple]:
    """(path, entity, definition, row, name, type, is_pk, related, pairs): a row for each
    entity, field (of a name once) and relationship; aliases are derived fields."""
    nodes, parents, _, ends = nest(tags(text))
    kinds = [local(t.name).lower() for t in nodes]
    attributes = [{k.lower(): v.strip() for k, v in t.attributes.items()} for t in nodes]
    home = nearest_flagged(parents, [k in _ENTITY for k in kinds])
    parent = nearest_flagged(parents, [k == "relationship" for k in kinds])
    rows: dict[int, dict[str, list]] = {k: {"field": [], "alias": [], "relationship": []} for k, kind in enumerate(kinds) if kind in _ENTITY and ends[k]}
    pairs: dict[int, list] = defaultdict(list)
    for k, (kind, a) in enumerate(zip(kinds, attributes)):
        if kind == "key-map":
            pairs[parent[k]].append((a.get("field-name", ""), first(a, "related", "related-field-name")))
        elif home[k] in rows and kind in rows[home[k]]:
            rows[home[k]][kind].append(k)
    for k, inside in rows.items():
        entity = first(attributes[k], "entity-name", "name")
        if not entity:
            continue
        package, head = first(attributes[k], "package-name", "package"), (path, entity, kinds[k])
        yield *head, "entity", f"{package}.{entity}" if package else entity, None, None, None, None
        fields = {}
        for j in inside["field"] + inside["alias"]:
            a, plain = attributes[j], kinds[j] == "field"
            if a.get("name"):
                fields.setdefault(a["name"], (a.get("type", "") if plain else "derived", plain and a.get("is-pk", "").lower() == "true"))
        for name, (type_, pk) in fields.items():
            yield *head, "field", name, type_, pk, None, None
        for j in inside["relationship"]:
            a = attributes[j]
            yield *head, "relationship", first(a, "title", "short-alias", "type"), a.get("type", ""), None, first(a, "related", "related-entity-name"), pairs[j]


# Settings and data ------------------------------------------------------------------------


def _number(digits: str):
    x = float(digits)
    return int(x) if x.is_integer() and abs(x) < 1e21 else x


def _parsed(text: str):
    try:
        return json.loads(text, parse_float=_number)
    except ValueError:
        return None


def _plain(v) -> bool:
    return not isinstance(v, (dict, list))


def flatten_json(path: str, text: str) -> Iterable[tuple]:
    """(path, key, value, line) of scalars by dotted path; lists of at most 12 scalars are
    joined, nulls in them as nothing; other lists are left out."""
    todo = [((), _parsed(text))]
    while todo:
        at, v = todo.pop()
        if isinstance(v, dict):
            todo += [((*at, k), child) for k, child in reversed(v.items())]
        elif _plain(v):
            if at or v is not None:
                yield path, ".".join(at), v if isinstance(v, str) else json.dumps(v), None
        elif len(v) <= 12 and all(map(_plain, v)):
            yield path, ".".join(at), ", ".join("" if x is None else x if isinstance(x, str) else json.dumps(x) for x in v), None


def json_objects(path: str, text: str) -> Iterable[tuple]:
    """(path, object, fields) of every object inside a list, called by its path and its id,
    name, key, type, code or place; the first 30 field names."""
    todo = [((), _parsed(text))]
    while todo:
        at, v = todo.pop()
        if isinstance(v, dict):
            todo += [((*at, k), child) for k, child in reversed(v.items())]
        elif isinstance(v, list):
            for k, x in enumerate(v):
                if isinstance(x, dict):
                    own = next((x[n] for n in ("id", "name", "key", "type", "code") if x.get(n)), k)
                    yield path, ".".join([*at, str(own).strip() or str(k)]), list(x)[:30]
            todo += [((*at, str(k)), x) for k, x in reversed(list(enumerate(v)))]


_FLAT = re.compile(r"\s*(?P<key>[A-Za-z_][\w.-]*)\s*[=:]\s*(?P<value>.*?)\s*$")
_NESTED = re.compile(r"(?P<indent>\s*)(?P<key>[A-Za-z0-9_.-]+)\s*:\s*(?P<value>.*?)\s*$")


def settings(path: str, text: str, most: int = 600) -> Iterable[tuple]:
    """(path, key, value, line) of a settings file, by its extension; the first ``most``."""
    form = path.lower().rpartition(".")[2]
    rows: list[tuple] = []
    if form == "json":
        rows = list(flatten_json(path, text))
    elif form in ("yaml", "yml"):
        above: dict[int, str] = {}  # by indent, the keys that hold what follows
        for n, line in enumerate(text.splitlines(), 1):
            m = None if line.lstrip().startswith("#") else _NESTED.match(line)
            if m:
                width = len(m["indent"])
                above = {w: k for w, k in above.items() if w < width}
                if m["value"]:
                    rows.append((path, ".".join([*above.values(), m["key"]]), m["value"], n))
                else:
                    above[width] = m["key"]
    else:
        rows = [(path, m["key"], m["value"], n) for n, line in enumerate(text.splitlines(), 1) if (m := _FLAT.match(line))]
    yield from rows[:most]


PAIRS = "array<struct<key:string,value:string>>"
SYMBOL = "path string, name string, kind string, signature string, start_line int, end_line int, body string"
SCHEMAS: dict[str, tuple[Callable, str]] = {
    "code": (code_symbols, SYMBOL),
    "named": (named_markup, SYMBOL),
    "markup": (markup_tree, f"path string, ordinal int, tag string, parent int, depth int, start int, end int, attributes {PAIRS}"),
    "executable": (executable, f"path string, ordinal int, tag string, parent int, line int, identity string, attributes {PAIRS}"),
    "units": (units, f"path string, ordinal int, tag string, name string, line int, attributes {PAIRS}, reference string, relation string"),
    "settings": (settings, "path string, key string, value string, line int"),
    "json": (flatten_json, "path string, key string, value string, line int"),
    "objects": (json_objects, "path string, object string, fields array<string>"),
    "entities": (entity_schemas, "path string, entity string, definition string, row string, name string, type string, is_pk boolean, related string, pairs array<struct<field:string,related:string>>"),
}


def extract(files: DataFrame, form: str, only: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a parser over (path, text), of all columns or ``only`` some.  Narrow; one document
    at a time."""
    parse, schema = SCHEMAS[form]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    every = _parse_datatype_string(schema)
    at = [k for k, f in enumerate(every) if not only or f.name in only]
    kept = StructType([every[k] for k in at])
    arrow = to_arrow_schema(kept)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([_column(columns[k], f.type) for k, f in zip(at, arrow)], schema=arrow)

    def run(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                rows += parse(path or "", text or "")
                if len(rows) > 5000:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)

    return files.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text")).mapInArrow(run, kept)


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    """Lists of pairs become lists of structs, built column by column: a dict per pair costs more
    than parsing it."""
    if not (pa.types.is_list(kind) and pa.types.is_struct(kind.value_type)):
        return pa.array(values, kind)
    # A null offset makes the list that begins there null.
    lengths = [0, *accumulate(len(v) if v is not None else 0 for v in values)]
    offsets = pa.array([n if k == len(values) or values[k] is not None else None for k, n in enumerate(lengths)], pa.int32())
    fields = list(zip(*chain.from_iterable(v for v in values if v is not None))) or [()] * kind.value_type.num_fields
    flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(fields, kind.value_type)], fields=list(kind.value_type))
    return pa.ListArray.from_arrays(offsets, flat, type=kind)


# References -------------------------------------------------------------------------------


def _as(relation: str):
    return lambda name: F.struct(name.alias("name"), F.lit(relation).alias("relation"))


def call_references(symbols: DataFrame, most: int = 80, in_all: int = 100) -> DataFrame:
    """(path, symbol, pos, name, relation) of up to ``most`` calls in bodies, and then of what
    markup there refers to, ``in_all`` at most; own names aside.  symbols: path, name, body."""
    other = lambda n: n != F.col("name")
    calls = F.filter(F.regexp_extract_all("body", F.lit(r"\b([A-Za-z_$][\w$]*)\s*\("), 1), lambda n: ~n.isin(*NOT_CALLS) & other(n))
    lists = [F.transform(F.slice(calls, 1, most), _as("calls"))]
    for relation, (names, key) in MARKUP_REFERENCES.items():
        lists.append(F.transform(F.filter(F.regexp_extract_all("body", F.lit(rf"<(?:{names})\b[^>]*\b{key}=[\"']([^\"']+)[\"']"), 1), other), _as(relation)))
    rows = symbols.select("path", F.col("name").alias("symbol"), F.posexplode(F.slice(F.concat(*lists), 1, in_all)).alias("pos", "r"))
    return rows.select("path", "symbol", "pos", "r.name", "r.relation")


def child_tags(tree: DataFrame) -> DataFrame:
    """Direct children by tag."""
    return tree.where("parent IS NOT NULL").groupBy("path", "parent", "tag").agg(F.count("*").alias("n"))


def environment_references(symbols: DataFrame) -> DataFrame:
    names = F.array_distinct(F.regexp_extract_all("body", F.lit(r"process\.env\.([A-Za-z_]\w*)"), 1))
    return symbols.select("path", F.col("name").alias("symbol"), F.explode(names).alias("variable")).select("path", "symbol", F.concat(F.lit("$env."), "variable").alias("name"), F.lit("configured_by").alias("relation"))


def constants(files: DataFrame) -> DataFrame:
    """Upper-case constants with values of at most 160 signs."""
    found = F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:export\s+)?const\s+([A-Z][A-Z0-9_]+)\s*=\s*[^;\n]{1,160}"), 1)
    return files.select("path", F.explode(F.array_distinct(found)).alias("name"))


def constant_references(symbols: DataFrame, known: DataFrame) -> DataFrame:
    """(path, symbol, name, relation): symbols whose body has the word of a constant of the
    same file; an equi-join on words.  symbols: path, name, body; known: path, name."""
    words = F.array_distinct(F.regexp_extract_all("body", F.lit(r"\b([A-Z][A-Z0-9_]+)\b"), 1))
    used = symbols.select("path", F.col("name").alias("symbol"), F.explode(words).alias("name")).where("symbol <> name")
    return used.join(known.select("path", "name").distinct(), ["path", "name"]).select("path", "symbol", "name", F.lit("configured_by").alias("relation"))


def normal_path(folder, target):
    """A relative path from a folder, as a column, without its dots; up to eight steps up."""
    out = F.concat_ws("/", F.nullif(folder, F.lit("")), target)
    out = F.regexp_replace(out, r"(?:^|(?<=/))(?:\./)+", "")
    for _ in range(8):
        out = F.regexp_replace(out, r"(?:^|(?<=/))(?!\.\./)[^/]+/\.\./", "")
    return out


def setting_references(files: DataFrame, symbols: DataFrame, known: DataFrame) -> DataFrame:
    """(path, symbol, file, key): uses of settings through an imported name.

    files: path, text; symbols: path, name, body; known settings: path, key."""
    imports = F.regexp_extract_all("text", F.lit(r"\b(?:(?:const|let|var)\s+[A-Za-z_$][\w$]*\s*=\s*require\([\"'][^\"']+\.(?:json|ya?ml)[\"']\)|import\s+[A-Za-z_$][\w$]*\s+from\s+[\"'][^\"']+\.(?:json|ya?ml)[\"'])"), 0)
    named = files.select("path", F.explode(imports).alias("i")).select("path", F.regexp_extract("i", r"^\w+\s+([A-Za-z_$][\w$]*)", 1).alias("alias"), F.regexp_extract("i", r"[\"']([^\"']+)[\"']", 1).alias("target"))
    folder = F.regexp_replace(F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), "/$", "")
    named = named.select("path", "alias", normal_path(folder, F.col("target")).alias("file"))
    chains = F.array_distinct(F.regexp_extract_all("body", F.lit(r"(?<![\w$.])([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+)"), 1))
    used = symbols.select("path", F.col("name").alias("symbol"), F.explode(chains).alias("chain")).select("path", "symbol", F.substring_index("chain", ".", 1).alias("alias"), F.expr("substring(chain, instr(chain, '.') + 1)").alias("key"))
    low = known.select(F.lower("path").alias("lf"), F.lower("key").alias("lk")).distinct()
    found = used.join(named, ["path", "alias"]).select("path", "symbol", "file", "key")
    return found.join(low, (F.lower("file") == F.col("lf")) & (F.lower("key") == F.col("lk"))).select("path", "symbol", "file", "key").distinct()


#: How code hands over handlers: (pattern, relation of the event to its handler).
REGISTERED = [
    (r"\.addEventListener\(\s*[\"']([^\"']+)[\"']\s*,\s*([A-Za-z_$][\w$]*)", "triggers"),
    (r"\bon([A-Z][A-Za-z0-9_]*)\s*=\s*\{?\s*([A-Za-z_$][\w$]*)", "triggers"),
    (r"\.on\(\s*[\"']([^\"']+)[\"']\s*,\s*([A-Za-z_$][\w$]*)", "handles"),
]
CONTINUED = {"on_success": r"\.then\(\s*([A-Za-z_$][\w$]*)", "on_error": r"\.catch\(\s*([A-Za-z_$][\w$]*)", "delayed_trigger": r"\bset(?:Timeout|Interval)\(\s*([A-Za-z_$][\w$]*)"}


def _edge(source, relation: str, target):
    return F.struct(source.alias("source"), F.lit(relation).alias("relation"), target.alias("target"))


def _event(name):
    return F.concat(F.lit("$event."), name)


def _registers(name):
    return _edge(F.col("name"), "registers", _event(name))


def _handles(relation: str):
    return lambda name, handler: _edge(_event(name), relation, handler)


def _continues(relation: str):
    return lambda target: _edge(F.col("name"), relation, target)


def callbacks(symbols: DataFrame) -> DataFrame:
    """(path, source, relation, target) of callbacks: a symbol registers an event, the event
    triggers or handles a function, and promises and timers go on to functions.
    symbols: path, name, body."""
    lists = []
    for pattern, relation in REGISTERED:
        names, handlers = (F.regexp_extract_all("body", F.lit(pattern), k) for k in (1, 2))
        small = F.transform(names, lambda n: F.concat(F.lower(F.substring(n, 1, 1)), F.substring(n, 2, 1 << 20))) if "on([A-Z]" in pattern else names
        lists.append(F.transform(small, _registers))
        lists.append(F.zip_with(small, handlers, _handles(relation)))
    for relation, pattern in CONTINUED.items():
        lists.append(F.transform(F.regexp_extract_all("body", F.lit(pattern), 1), _continues(relation)))
    return symbols.select("path", F.explode(F.concat(*lists)).alias("e")).select("path", "e.*").distinct()
