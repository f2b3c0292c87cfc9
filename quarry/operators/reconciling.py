"""Entity reconciliation in passes that read only what the last one changed.

A name that no schema resolves is offered with its candidate schemas and the contexts that it
is used in.  What is offered has a fingerprint; a ledger keeps the fingerprint of each name's
last attempt, so the same evidence is never judged twice.  A judgment may map a name only to
schemas that were offered for it, and a mapped name's contexts gain the schema: names used in
the same contexts then have new evidence, and only those are looked at in the next pass.  Passes
end when one changes nothing, or after ``most``.

The first pass looks at all names; a later one at those that share a context which a name just
mapped gave a schema (semi-naive evaluation): the others offer what they offered before and are
in the ledger already.  What a name's contexts hold is kept as sums beside it, and a pass adds to
them what its contexts gained.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import label_key
from quarry.operators.arcs import last_rows
from quarry.runtime import dealt, discard, materialise

#: Passes, names of one packet, and runs that the history keeps.
PASSES, TARGETS, RUNS = 3, 6, 80
#: Sums of a name's contexts and the schemas there, two hashes' xors, beside their count.
SUMS = ("mark", "again")


@dataclass
class Reconciled:
    """What a reconciliation leaves: mappings (name, schema), the ledger (name, fingerprint),
    and the history (step, offered, mapped), newest last."""

    mappings: DataFrame
    ledger: DataFrame
    runs: list[tuple[int, int, int]]


def _hash(name: str, *schema: str) -> Column:
    """The hash of a context, and a schema, that goes into the sum ``name``."""
    return F.xxhash64(*([F.lit("again")] if name == "again" else []), "context", *schema)


def opened(names: DataFrame, candidates: DataFrame, contexts: DataFrame) -> DataFrame:
    """(name, ord, offered, uses, mark, again): names with a candidate and a context, and what
    they offer while nothing is mapped.  names: name, ord; candidates: name, schema, score;
    contexts: name, context, each once."""
    rows = names.select("name", "ord", F.lit(True).alias("named"))
    rows = rows.unionByName(candidates.select("name", F.struct("schema", "score").alias("offer")), allowMissingColumns=True)
    offers = dealt(rows, names.count() + candidates.count(), "name", least=names.sparkSession.sparkContext.defaultParallelism).groupBy("name")
    offers = offers.agg(F.min("ord").alias("ord"), F.array_sort(F.collect_set("offer")).alias("offered"), F.max("named").alias("named"))
    offers = offers.where("named AND size(offered) > 0").drop("named")
    sums = contexts.groupBy("name").agg(F.count("*").alias("uses"), *(F.bit_xor(_hash(n)).alias(n) for n in SUMS))
    return offers.join(sums, "name")


def shared(contexts: DataFrame, known: DataFrame, new: DataFrame) -> DataFrame:
    """(context, schema, fresh): the schemas that contexts have; fresh are those that only names
    just mapped give.  contexts: name, context; known: context, schema; new: name, schema."""
    found = contexts.join(new, "name").select("context", "schema", F.lit(True).alias("fresh"))
    return known.select("context", "schema", F.lit(False).alias("fresh")).unionByName(found).groupBy("context", "schema").agg(F.min("fresh").alias("fresh"))


def gained(known: DataFrame) -> DataFrame:
    """(context, uses, mark, again): what each context with a fresh schema adds to the sums of
    its names.  Until it has a schema a context counts once, without one.  known: as of ``shared``."""
    marks = (F.bit_xor(F.when(F.col("fresh"), _hash(n, "schema"))).alias(n) for n in SUMS)
    rows = known.groupBy("context").agg(F.count_if("fresh").alias("uses"), F.every("fresh").alias("first"), *marks).where("uses > 0")
    first = F.col("first")
    return rows.select("context", (F.col("uses") - first.cast("long")).alias("uses"), *(F.when(first, F.col(n).bitwiseXOR(_hash(n))).otherwise(F.col(n)).alias(n) for n in SUMS))


def added(open_: DataFrame, contexts: DataFrame, gain: DataFrame, new: DataFrame) -> DataFrame:
    """``open_`` without the names just mapped, with what the contexts of the others gained;
    ``moved`` are names that have such a context.  gain: as of ``gained``."""
    sums = contexts.join(gain, "context").groupBy("name").agg(F.sum("uses").alias("_uses"), *(F.bit_xor(n).alias("_" + n) for n in SUMS))
    rows = open_.join(new.select("name").distinct(), "name", "left_anti").join(sums, "name", "left")
    more = {n: F.col(n).bitwiseXOR(F.coalesce("_" + n, F.lit(0))) for n in SUMS}
    return rows.select("name", "ord", "offered", (F.col("uses") + F.coalesce("_uses", F.lit(0))).alias("uses"), *(c.alias(n) for n, c in more.items()), F.col("_uses").isNotNull().alias("moved"))


def packet(open_: DataFrame, ledger: DataFrame, most: int | None = TARGETS) -> DataFrame:
    """(name, ord, fingerprint, schemas): what is offered in one pass, but for offers that were
    judged before.  With ``most``, the first of them in order.

    An offer is a name's candidates with their scores and its contexts with the schemas that
    other names are mapped to there.  The contexts enter the fingerprint as a count and two xors
    of hashes, whatever their order, so a name that is used everywhere is never one list.
    open_: as of ``opened``; ledger: name, fingerprint."""
    used = F.struct(*(F.col(n).alias(f"col{k}") for k, n in enumerate(("uses", *SUMS), 1)))
    rows = open_.withColumn("fingerprint", F.sha1(F.to_json(F.struct("name", "offered", used.alias("used")))))
    fresh = rows.join(ledger.select("name", "fingerprint"), ["name", "fingerprint"], "left_anti")
    few = fresh if most is None else fresh.orderBy("ord", "name").limit(most)
    return few.select("name", "ord", "fingerprint", F.transform("offered", lambda o: o.schema).alias("schemas"))


def accepted(offered: DataFrame, judged: DataFrame) -> DataFrame:
    """(name, schema) of judgments that map an offered name to a schema offered for it.
    judged: name, schema."""
    allowed = offered.select("name", F.explode("schemas").alias("schema"))
    return judged.where("schema IS NOT NULL").select("name", "schema").distinct().join(allowed, ["name", "schema"], "left_semi")


def reconcile(names: DataFrame, candidates: DataFrame, contexts: DataFrame, judge: Callable[[DataFrame, int], DataFrame], before: Reconciled | None = None, passes: int = PASSES, most: int | None = TARGETS) -> Reconciled:
    """Passes of offer, judgment, mapping and ledger until nothing changes.

    ``judge`` gets what is offered (name, ord, fingerprint, schemas) and the pass's number and
    gives (name, schema) rows.  Names that differ in case or spacing are one.  With ``most``,
    a packet is cut and what is left over waits: then a pass reads all open names, as it can't
    know that those it hasn't offered yet are in the ledger.
    names: name, ord; candidates: name, schema, score; contexts: name, context; a null name is
    dropped; empty tables give no mapping and a history of no runs."""
    keyed = lambda df: df.withColumn("name", label_key(F.col("name"))).where("name IS NOT NULL AND name <> ''")
    names, candidates, uses = (materialise(keyed(df), "reconciling") for df in (names, candidates, contexts))
    contexts = dealt(uses.select("name", "context").where("context IS NOT NULL"), uses.count(), "name", "context", least=names.sparkSession.sparkContext.defaultParallelism)
    # A name's contexts lie together, unless they are many: then tasks add them up before they deal the sums.
    contexts = materialise(contexts.distinct().hint("rebalance", "name"), "contexts")
    mappings = before.mappings if before else candidates.select("name", "schema").limit(0)
    ledger = before.ledger if before else names.select("name", F.lit("").alias("fingerprint")).limit(0)
    runs = list(before.runs) if before else []
    step = runs[-1][0] if runs else 0
    open_, new = materialise(opened(names, candidates, contexts), "open"), mappings if before else None
    known = candidates.select(F.lit("").alias("context"), "schema").limit(0)
    discard(names, candidates, uses)
    for nth in range(passes):
        if new is not None:
            known = materialise(shared(contexts, known, new), "known")
            gain, was = materialise(gained(known), "gained"), open_
            open_ = materialise(added(was, contexts, gain, new), "open")
            discard(was, gain)
        # A packet that was cut leaves names that aren't in the ledger: then all open ones are looked at.
        offered = materialise(packet(open_.where("moved") if nth and most is None else open_, ledger, most), "packet")
        n = offered.count()
        if not n:
            break
        step += 1
        new = materialise(accepted(offered, keyed(judge(offered, step))), "mapped")
        mappings = mappings.unionByName(new)
        tried = offered.select("name", "fingerprint")
        ledger = materialise(ledger.join(tried, "name", "left_anti").unionByName(tried), "ledger")
        mapped = new.count()
        runs.append((step, n, mapped))
        discard(offered)
        if not mapped:
            break
    return Reconciled(mappings, ledger, runs[-RUNS:])


def run_history(runs: DataFrame, most: int = RUNS) -> DataFrame:
    """The last runs of each repository, as a table.  runs: repo, step, offered, mapped."""
    return last_rows(runs, "repo", "step", most).drop("age")
