"""Every analysis under a collation that ignores case and accents."""

from decimal import Decimal

import pytest
from builders import build, one, rows

from orderlens import registry
from orderlens.plans import marts, products, semantic
from orderlens.plans.semantic import Context, Model

COLLATION = "UNICODE_CI_AI"
KEYS = {**registry.INTAKE, **registry.ANALYSES, **registry.MEASURES}


@pytest.fixture(scope="module")
def collated(warehouse):
    return warehouse.collated(COLLATION)


@pytest.mark.parametrize("key", list(KEYS))
def test_every_key_is_planned(collated, key):
    KEYS[key](collated)._jdf.queryExecution().executedPlan()


@pytest.fixture(scope="module")
def shop(spark):
    """Categories, states and statuses that differ in case or accents only."""
    return build(
        spark, customers=[{"customer_id": "c1", "customer_state": "SP"}, {"customer_id": "c2", "customer_state": "sp"}],
        orders=[{"order_id": "o1", "order_status": "Delivered"}, {"order_id": "o2", "customer_id": "c2"},
                {"order_id": "o3", "order_status": "canceled"}],
        order_items=[{"order_id": "o1", "product_id": "p1"}, {"order_id": "O2", "product_id": "P2"}, {"order_id": "o2", "product_id": "p3"}],
        products=[{"product_id": "p1", "product_category_name": "Moveis"}, {"product_id": "p2", "product_category_name": "m\u00f3veis"},
                  {"product_id": "p3", "product_category_name": "  "}],
        payments=[{"order_id": "O1"}, {"order_id": "o2", "payment_type": "Credit_Card"}]).collated(COLLATION)


def test_categories_merge(shop):
    assert products.category_sales(shop).count() == 2
    merged = {r["product_category"]: r["items"] for r in rows(Model(shop).category_sales())}
    assert sorted(merged.values()) == [1, 2]


def test_filters_joins_and_groups_follow(shop):
    assert one(semantic.core(Model(shop)))["orders"] == 2
    assert one(semantic.core(Model(shop, Context(states=("Sp",)))))["revenue"] == Decimal("30.00")
    assert [r["payment_value"] for r in rows(semantic.payment_mix(Model(shop)))] == [Decimal("22.00")]
    assert marts.sales(shop).count() == 3


def test_blank_names_are_uncategorized(shop):
    assert sorted(str(r["product_category"]) for r in rows(marts.product_categories(shop)))[-1] == "m\u00f3veis"
    assert marts.UNCATEGORIZED in {r["product_category"] for r in rows(marts.product_categories(shop))}
