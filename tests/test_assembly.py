"""Walks, packets, qualified names, merging, and the synthetic estate."""

import pytest

from quarry.operators import assembly, profile, walk
from quarry.sources import estate


def test_walk(spark):
    edges = spark.createDataFrame([("w", "A", "uses"), ("A", "B", "fk"), ("B", "C", "fk"), ("A", "D", "fk")], "src string, dst string, relation string")
    wishes = iter([["B"], ["A", "D"], []])
    w = walk.investigate(edges, "A", lambda _: next(wishes))
    assert w.visited == ["A", "B", "D"] and set(w.open) == {"w", "C"} and len(w.kept) == 4
    with pytest.raises(ValueError):
        w.expand("B")


def test_packets(spark):
    blank = {"artifactId": "", "relation": "r", "signature": "s"}
    row = {
        "phase": "other",
        "currentEvidence": {"artifactId": "x" * 1200, "artifactType": "t", "canonicalContent": "c", "provenance": None},
        "neighbours": [blank] + [{"artifactId": f"n{k}", "relation": "r", "signature": "s"} for k in range(300)],
        "arcs": [{"arcId": "a", "title": "T" * 600, "arcType": "x", "steps": ["s"] * 150}],
        "recentPath": None,
    }
    none = dict(row, currentEvidence={"artifactId": None})
    raw = spark.createDataFrame([row, none], walk.PACKET)
    good, bad = walk.packets(raw)
    p = good.first()
    assert good.count() == bad.count() == 1
    assert p.phase == "scout" and len(p.currentEvidence.artifactId) == 1000 and len(p.neighbours) == 249
    assert p.arcs[0].arcType == "business" and len(p.arcs[0].title) == 500 and len(p.arcs[0].steps) == 100 and p.recentPath == []


def test_qualified_names(spark):
    services = spark.createDataFrame([(1, "place#Order", "svc/shop/order/OrderServices.xml"), (2, "place#Order", "other/OrderServices.xml"), (3, "place#Order", "x/Else.xml")], "id int, name string, path string")
    refs = spark.createDataFrame([(1, "shop.order.OrderServices.place#Order"), (2, "place#Order")], "ref int, name string")
    assert sorted(map(tuple, assembly.resolve_services(refs, services).collect())) == [(1, 1, 110), (1, 2, 10)]
    screens = spark.createDataFrame([(1, "app/screen/Home.xml"), (2, "screen/Edit.xml"), (3, "z/Only.xml")], "id int, path string")
    urls = ["../screen/Home?x=1", "Edit", "q/Only.xml", "${x}/Home", "https://x/Home", "Gone"]
    asked = spark.createDataFrame([(k, "app/sub/S.xml", u) for k, u in enumerate(urls)], "ref int, source string, url string")
    assert {(r.ref, r.screen) for r in assembly.resolve_screens(asked, screens).collect()} == {(0, 1), (1, 2), (2, 3)}


def test_knowledge_merges(spark):
    items = spark.createDataFrame(
        [("a", "rule", "One", ["t1"], "short", ["f"], "c1", 1), ("b", "rule", " one ", [], "much longer", ["g", "f"], "c2", 2), ("c", "rule", "Other", ["T1"], "x", [], None, 3), ("d", "data", "One", [], "y", [], None, 4)],
        "item string, kind string, label string, names array<string>, description string, files array<string>, commit string, ord long",
    )
    canonical = assembly.same_knowledge(items)
    assert {(r.item, r.canonical) for r in canonical.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")}
    merged = {r.item: r for r in assembly.merge_knowledge(items, canonical).collect()}
    assert merged["a"].description == "much longer" and merged["a"].files == ["f", "g"] and merged["a"].commit == "c2" and merged["a"].names == ["t1", "T1"]


def test_documents_and_members(spark):
    uses = spark.createDataFrame([("w", "A", 1), ("w", "B", 2), ("v", "B", 1)], "workflow string, entity string, ord int")
    fields = spark.createDataFrame([("A", "x", 2), ("A", "y", 1)], "entity string, field string, ord int")
    steps = spark.createDataFrame([("w", "s2", 2), ("w", "s1", 1)], "workflow string, name string, ord int")
    docs = {r.workflow: r for r in assembly.workflow_documents(uses, fields, steps).collect()}
    assert [(e.name, e.fields) for e in docs["w"].entities] == [("A", ["y", "x"]), ("B", [])] and docs["w"].steps == ["s1", "s2"] and docs["v"].steps == []
    relations = spark.createDataFrame([(1, "A", "B", None), (2, "B", "Z", "v")], "relation int, from string, to string, workflow string")
    assert {tuple(r) for r in assembly.members_of(relations, uses).collect()} == {("w", 1), ("v", 2)}
    assert {tuple(r) for r in assembly.relations_of(relations, uses.where("workflow = 'v'")).collect()} == {(1, "B"), (2, "B")}
    s = spark.createDataFrame([("k", "a", 1, None, None), ("k", "b", 2, None, None), ("k", "c", 3, "b", "before")], "story string, step string, ord int, anchor string, place string")
    assert [r.step for r in assembly.insert_steps(s).orderBy("position").collect()] == ["a", "c", "b"]


def test_estate(spark):
    tables = estate.estate(spark)
    overlap = profile.value_overlap(tables)
    ranked = profile.rank_relationships(overlap)
    found = {(r.left, r.right) for r in ranked.collect()}
    precision, recall = estate.evaluate(found)
    assert recall == 1.0 and precision < 1.0  # value overlap alone falls for the false friend
    assert any("cost_centre_reference.code" in pair for pair in found)
    typed = profile.typed_key_candidates(overlap, profile.column_profile(tables))
    better, again = estate.evaluate({(r["from"], r.to) for r in typed.collect()})
    assert again == 1.0 and better >= precision
    swapped = {f"{99 - k:02d}_{n}": t for k, (n, t) in enumerate(sorted(tables.items()))}
    other = {frozenset(x.split("_", 1)[1] for x in (r.left, r.right)): r.score for r in profile.rank_relationships(profile.value_overlap(swapped)).collect()}
    assert other == {frozenset((r.left, r.right)): r.score for r in ranked.collect()}


def test_samples_are_cut_before_they_are_sorted(spark):
    values = [chr(c) + str(k % 3) for k, c in enumerate([0x1F600, 0xFFFD, 0xE9, 0x7A, 0x41, 0x30, 0x4E2D] * 40)] + ["", None]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(5)
    got = profile.column_profile({"t": df, "e": df.limit(0)}, samples=20)
    row = got.where("dataset = 't'").first()
    assert row.samples == sorted({v for v in values if v}, key=str.encode)[:20] and row.distinct == 21 and row.non_null == 280
    # A task's rows for the window are the few it keeps.
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_steps_are_dealt_by_their_number(spark, monkeypatch):
    from quarry import runtime

    monkeypatch.setattr(runtime, "TASK_ROWS", 20)
    rows = [(s, k, k, None, None) for s in range(30) for k in (1, 2)] + [(s, 9, 9, 1 + s % 2, ("before", "after", None)[s % 3]) for s in range(30)] + [(3, 8, 0, 7, "before")]
    got = assembly.insert_steps(spark.createDataFrame(rows, "story int, step int, ord int, anchor int, place string"))
    # Merging of small tasks must not make them grow with the input.
    assert got.rdd.getNumPartitions() == 1 + len(rows) // 20
    order = {s: [r.step for r in sorted(got.collect(), key=lambda r: r.position) if r.story == s] for s in range(4)}
    assert order == {0: [9, 1, 2], 1: [1, 2, 9], 2: [1, 2, 9], 3: [8, 1, 9, 2]}
