"""Data views: a small declarative plan, its checks, and its compilation to a DataFrame.

A view names fields to select (with a role), joins, filters, grouping and order.  Joins are
allowed only between entities that evidenced links with key maps connect; the columns joined
on come from those key maps, all pairs of a composite key together.  A view whose joins lack
evidence is refused, never turned into a cross join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class UnevidencedJoin(ValueError):
    """A view needs a join that no evidence supports."""


@dataclass(frozen=True)
class Item:
    entity: str
    field: str
    alias: str = ""
    role: str = "dimension"  # dimension, measure, key
    aggregate: str = "sum"  # the spec names none for measures: sum unless told otherwise

    @property
    def name(self) -> str:
        return self.alias or self.field


@dataclass(frozen=True)
class Join:
    left: str
    right: str
    relation: str = ""
    evidenced: bool = False


@dataclass(frozen=True)
class Link:
    """An evidenced relationship: which columns of two entities belong together."""

    left: str
    right: str
    pairs: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class View:
    select: tuple[Item, ...]
    joins: tuple[Join, ...] = ()
    filters: tuple[str, ...] = ()
    group_by: tuple[str, ...] = ()
    order_by: tuple[tuple[str, str], ...] = ()
    missing: tuple[str, ...] = ()
    grain: str = ""


def _key(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", name.lower())


def friendly(name: str) -> bool:
    """Whether a name reads like a business entity."""
    return bool(re.fullmatch(r"[A-Za-z][A-Za-z0-9 _-]{0,69}", name or "")) and not re.search(r"\b(service|record|result|created)\b", name, re.I)


def sanitise(view: View, links: list[Link]) -> View:
    """Drop joins without evidence and say so; keep the first eight distinct fields, five
    joins that touch them, and the bounds on the rest."""
    items, seen = [], set()
    for item in view.select:
        key = (_key(item.entity), _key(item.field))
        if friendly(item.entity) and item.field and key not in seen:
            seen.add(key)
            items.append(item)
    items = items[:8]
    chosen = {_key(i.entity) for i in items}
    known = {frozenset((_key(x.left), _key(x.right))) for x in links if x.pairs}
    joins, missing = [], list(view.missing)
    for join in view.joins:
        a, b = join.left.split(".")[0], join.right.split(".")[0]
        if frozenset((_key(a), _key(b))) in known:
            if friendly(a) and friendly(b) and {_key(a), _key(b)} & chosen:
                joins.append(replace(join, left=a, right=b, evidenced=True))
        elif a and b:
            missing.append(f"no evidenced join between {a} and {b}")
    return replace(view, select=tuple(items), joins=tuple(joins[:5]), filters=view.filters[:4], group_by=view.group_by[:4], order_by=view.order_by[:2], missing=tuple(dict.fromkeys(missing))[:4])


def qualify(view: View) -> View:
    """Grouping and order by output names."""
    names = {f"{i.entity}.{i.field}": i.name for i in view.select}
    return replace(view, group_by=tuple(names.get(g, g) for g in view.group_by), order_by=tuple((names.get(f, f), d) for f, d in view.order_by))


def compile_view(view: View, tables: dict[str, DataFrame], links: list[Link]) -> DataFrame:
    """A DataFrame for a view.  Filters are SQL over the tables' columns and come first, so
    that Catalyst pushes them and the column pruning to the scans."""
    wanted = len(view.joins)
    clean = qualify(sanitise(view, links))
    if len(clean.joins) < wanted:
        raise UnevidencedJoin("; ".join(clean.missing) or "a join doesn't touch a selected entity")
    by_pair = {frozenset((_key(x.left), _key(x.right))): x for x in links if x.pairs}
    frames = {_key(n): (n, df) for n, df in tables.items()}
    first = clean.joins[0].left if clean.joins else clean.select[0].entity
    done, out = {_key(first)}, frames[_key(first)][1].alias(_key(first))
    todo = list(clean.joins)
    while todo:
        step = next((j for j in todo if (_key(j.left) in done) != (_key(j.right) in done)), None)
        if step is None:
            if all(_key(j.left) in done and _key(j.right) in done for j in todo):
                break
            raise UnevidencedJoin("the joins don't connect")
        todo.remove(step)
        new = _key(step.right) if _key(step.left) in done else _key(step.left)
        old = _key(step.left) if new == _key(step.right) else _key(step.right)
        link = by_pair[frozenset((new, old))]
        pairs = link.pairs if _key(link.left) == old else tuple((b, a) for a, b in link.pairs)
        on = None
        for a, b in pairs:
            same = F.col(f"{old}.{a}") == F.col(f"{new}.{b}")
            on = same if on is None else on & same
        out = out.join(frames[new][1].alias(new), on)
        done.add(new)
    if {_key(i.entity) for i in clean.select} - done:
        raise UnevidencedJoin("a selected entity isn't joined")
    for condition in clean.filters:
        out = out.where(condition)
    ref = lambda i: F.col(f"{_key(i.entity)}.{i.field}")
    measures = [i for i in clean.select if i.role == "measure"]
    if clean.group_by or measures:
        groups = [ref(i).alias(i.name) for i in clean.select if i.role != "measure"]
        out = out.groupBy(*groups).agg(*(getattr(F, i.aggregate)(ref(i)).alias(i.name) for i in measures)) if measures else out.select(*groups).distinct()
        out = out.select(*(i.name for i in clean.select))
    else:
        out = out.select(*(ref(i).alias(i.name) for i in clean.select))
    if clean.order_by:
        out = out.orderBy(*(F.col(f).desc() if d.lower().startswith("d") else F.col(f).asc() for f, d in clean.order_by))
    return out


def describe(view: View) -> list[str]:
    """A view in plain words."""
    out = [f"grain: {view.grain}"] if view.grain else []
    for entity in dict.fromkeys(i.entity for i in view.select):
        out.append(f"{entity}: " + ", ".join(i.name + (f" ({i.role})" if i.role else "") for i in view.select if i.entity == entity))
    if view.joins:
        out.append("joins: " + ", ".join(f"{j.left} - {j.right}" + ("" if j.evidenced else " (no evidence yet)") for j in view.joins))
    if view.group_by:
        out.append("grouped by " + ", ".join(view.group_by))
    if view.order_by:
        out.append("ordered by " + ", ".join(f"{f} {d}".strip() for f, d in view.order_by))
    return out + [f"missing: {m}" for m in view.missing]
