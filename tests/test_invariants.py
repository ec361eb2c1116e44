"""Properties that hold on any data."""

import random
from decimal import Decimal

import pytest
from builders import T0, build, one, rows

from orderlens.plans import advanced, customers, delivery, marts, payments, semantic
from orderlens.plans.semantic import Model
import datetime


@pytest.fixture(scope="module", params=[1, 2])
def w(spark, request):
    rng = random.Random(request.param)
    # Customer u0, product p0 and seller s0 hold about a third of everything.
    def pick(letter, n):
        return f"{letter}{0 if rng.random() < 0.33 else rng.randrange(n)}"
    people = [{"customer_id": f"c{i}", "customer_unique_id": pick("u", 20), "customer_state": rng.choice(["AA", "BB"])}
              for i in range(60)]
    orders, items, paid, scored = [], [], [], []
    for i in range(200):
        when = T0 + datetime.timedelta(days=rng.randrange(300), hours=rng.randrange(24))
        arrived = when + datetime.timedelta(hours=rng.randrange(-20, 1000)) if rng.random() < 0.9 else None
        orders.append({"order_id": f"o{i}", "customer_id": f"c{rng.randrange(60)}",
                       "order_status": rng.choice(["delivered", "delivered", "canceled"]),
                       "order_purchase_timestamp": when, "order_delivered_customer_date": arrived,
                       "order_estimated_delivery_date": when + datetime.timedelta(days=20)})
        for n in range(rng.randrange(4)):
            items.append({"order_id": f"o{i}", "order_item_id": n, "product_id": pick("p", 30),
                          "seller_id": pick("s", 12), "price": f"{rng.randrange(1, 9999)}.{rng.randrange(100):02d}",
                          "freight_value": f"{rng.randrange(99)}.50"})
        for n in range(rng.randrange(3)):
            paid.append({"order_id": f"o{i}", "payment_sequential": n,
                         "payment_type": rng.choice(["credit_card", "boleto"]),
                         "payment_installments": rng.randrange(12), "payment_value": f"{rng.randrange(999)}.25"})
            scored.append({"review_id": f"r{i}-{n}", "order_id": f"o{i}", "review_score": rng.randrange(1, 6)})
    return build(spark, customers=people, orders=orders, order_items=items, payments=paid, reviews=scored,
                 products=[{"product_id": f"p{i}", "product_category_name": rng.choice(["a", "b", "", None])}
                           for i in range(30)],
                 sellers=[{"seller_id": f"s{i}", "seller_state": rng.choice(["AA", "BB", "CC"])} for i in range(10)])


def test_control_totals_agree(w):
    sales = one(marts.sales_checks(w))
    totals = (sales["total_rows"], sales["total_revenue"])
    for check, count in ((marts.customers_checks, "total_items"), (marts.products_checks, "total_units_sold"),
                         (marts.sellers_checks, "total_units_sold"), (marts.monthly_sales_checks, "total_items")):
        found = one(check(w))
        assert (found[count], found["total_revenue"]) == totals
    core = one(semantic.core(Model(w)))
    assert (core["items"], core["revenue"], core["orders"]) == (*totals, sales["total_orders"])
    assert marts.sales(w).count() == sales["total_rows"]


def test_grains(w):
    orders = one(marts.orders_checks(w))
    assert orders["total_rows"] == orders["distinct_orders"]
    reviews = one(marts.reviews_checks(w))
    assert reviews["total_review_records"] == reviews["unique_review_order_records"]
    for mart, key in ((marts.customers, "customer_unique_id"), (marts.products, "product_id"),
                      (marts.sellers, "seller_id"), (marts.monthly_sales, "sales_month"), (marts.delivery, "order_id")):
        df = mart(w)
        assert df.count() == df.select(key).distinct().count()


@pytest.mark.parametrize(("query", "share"), [
    (customers.recency_segments, "customer_share_pct"), (customers.recency_frequency, "customer_share_pct"),
    (customers.rfm_segment_summary, "customer_share_pct"), (advanced.pareto_deciles, "revenue_share_pct"),
    (advanced.value_quartiles, "revenue_share_pct"), (delivery.time_groups, "order_share_pct"),
    (delivery.ontime_late, "order_share_pct"), (payments.installment_share, "value_share_pct"),
    (marts.delivery_by_status, "percentage"), (marts.reviews_by_score, "percentage"),
    (lambda w: semantic.payment_mix(Model(w)), "share_pct"),
    (lambda w: semantic.revenue_share_by_type(Model(w)), "share_pct")])
def test_shares_add_up(w, query, share):
    shares = [r[share] for r in rows(query(w))]
    assert abs(sum(shares) - 100) <= Decimal("0.01") * len(shares)


def test_retention_starts_at_one_hundred(w):
    first = [r for r in rows(advanced.cohort_retention(w)) if r["months_since_first_purchase"] == 0]
    assert first and all(r["retention_rate_pct"] == 100 for r in first)


def test_running_total_ends_at_the_total(w):
    assert rows(advanced.running_and_moving(w))[-1]["running_revenue"] == one(marts.sales_checks(w))["total_revenue"]


def test_buckets_are_even(w):
    sizes = [r["customer_count"] for r in rows(advanced.pareto_deciles(w))]
    assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


def test_reconciliation_by_order_adds_up(w):
    total = one(semantic.payment_reconciliation(Model(w)))["difference"]
    assert sum(r["difference"] for r in rows(semantic.reconciliation_by_order(Model(w)))) == total


def test_relationships_have_unique_keys_and_no_orphans(w):
    for r in rows(semantic.star_relationships(w)):
        assert r["one_rows"] == r["one_keys"]
        # Sellers s10 and s11 are unknown but sell, so the seller mart lists them.
        assert r["orphan_keys"] == 0
