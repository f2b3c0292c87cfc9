"""A small synthetic estate with planted defects, and an evaluator for what discovery finds.

Ten tables of one manufacturing business; keys go by different names, some references are
stale, some stock uses legacy codes, and one table's codes look like customers but aren't."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

#: The relationships that hold, as (referencing, referenced) columns.
TRUTH = {
    ("sales_order.buyer_ref", "customer_master.cust_no"),
    ("sales_order_line.sales_doc", "sales_order.order_no"),
    ("sales_order_line.material_code", "material_master.part_number"),
    ("warehouse_stock.sku", "material_master.part_number"),
    ("shipment.sales_ref", "sales_order.order_no"),
    ("machine_asset.material_ref", "material_master.part_number"),
    ("telemetry.device_ref", "machine_asset.asset_tag"),
    ("maintenance_event.equipment_ref", "machine_asset.asset_tag"),
}


def estate(spark: SparkSession, seed: int = 42) -> dict[str, DataFrame]:
    rng = random.Random(seed)
    customers = [(f"C{1000 + k}", f"Company {k if k != 31 else 30}", rng.choice(["OEM", "Retail"]), rng.choice(["North", "South"]), "" if k == 7 else f"X-{k}") for k in range(60)]
    parts = [(f"P-{200 + k}", f"Part {k}", rng.choice(["raw", "made"]), f"L{k:03d}") for k in range(40)]
    orders = [(f"SO{5000 + k}", f"C9{k:03d}" if k in (44, 97, 151) else rng.choice(customers)[0], f"2024-{1 + k % 12:02d}-01", rng.choice(["SHIPPED", "OPEN", "ALLOCATED"])) for k in range(180)]
    lines = [(o[0], str(n), rng.choice(parts)[0], str(rng.randint(1, 9)), f"{rng.random() * 90:.2f}") for o in orders for n in range(1, rng.randint(2, 5))]
    stock = [(rng.choice(parts)[3 if rng.random() < 0.04 else 0], rng.choice(["W1", "W2", "W3"]), str(rng.randint(0, 500)), "50") for _ in range(120)]
    shipments = [(f"SH{k}", o[0], rng.choice(["Fast", "Slow"]), o[2]) for k, o in enumerate(orders) if o[3] != "OPEN"]
    assets = [(f"A-{k}", parts[k][0], rng.choice(["Plant 1", "Plant 2"]), "2020-01-01") for k in range(20)]
    telemetry = [(rng.choice(assets)[0], f"2024-01-01T{k % 24:02d}:00:00", f"{20 + rng.random() * 60:.1f}", f"{rng.random():.2f}", f"{rng.random() * 9:.2f}") for k in range(800)]
    upkeep = [(f"M{k}", assets[k * 2][0], "2024-02-01", "repair", "note") for k in range(10)]
    false_friend = [(f"C{1000 + k}", f"Centre {k}") for k in range(30)]
    shapes = {
        "customer_master": ("cust_no legal_name segment region external_ref", customers),
        "material_master": ("part_number description category legacy_code", parts),
        "sales_order": ("order_no buyer_ref ordered_at state", orders),
        "sales_order_line": ("sales_doc line_no material_code qty unit_price", lines),
        "warehouse_stock": ("sku warehouse available_qty reorder_level", stock),
        "shipment": ("shipment_id sales_ref carrier shipped_at", shipments),
        "machine_asset": ("asset_tag material_ref plant commissioned_on", assets),
        "telemetry": ("device_ref ts temperature_c vibration_mm_s power_kw", telemetry),
        "maintenance_event": ("event_id equipment_ref event_time event_type notes", upkeep),
        "cost_centre_reference": ("code description", false_friend),
    }
    return {name: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns.split())) for name, (columns, rows) in shapes.items()}


def evaluate(found: set[tuple[str, str]], truth: set[tuple[str, str]] = TRUTH) -> tuple[float, float]:
    """(precision, recall) of undirected column pairs."""
    f, t = ({frozenset(p) for p in s} for s in (found, truth))
    hits = len(f & t)
    return hits / len(f) if f else 1.0, hits / len(t) if t else 1.0
