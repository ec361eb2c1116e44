"""Hand-made rows for the cases where definitions differ or data is awkward."""

import datetime
from decimal import Decimal

import pytest
from builders import T0, build, one, rows

from orderlens.plans import advanced, customers, delivery, kpi, marts, payments, products, sellers
from orderlens.plans.semantic import Context, Model
from orderlens.plans import semantic

DAY, HOUR = datetime.timedelta(days=1), datetime.timedelta(hours=1)
CUSTOMER = [{"customer_id": "c1"}]


def _order(order_id="o1", purchase=T0, delivered=None, due=None, **more):
    return {"order_id": order_id, "order_purchase_timestamp": purchase,
            "order_delivered_customer_date": delivered, "order_estimated_delivery_date": due, **more}


def test_full_days_and_calendar_days_differ_over_midnight(spark):
    late_evening = datetime.datetime(2020, 1, 10, 23)
    w = build(spark, customers=CUSTOMER,
              orders=[_order(purchase=late_evening, delivered=late_evening + 2 * HOUR, due=T0 + 5 * DAY)])
    assert one(delivery.time_stats(w))["fastest_delivery_days"] == 0
    assert one(marts.delivery(w))["delivery_days"] == 1


def test_negative_days_truncate_and_form_a_null_group(spark):
    w = build(spark, orders=[_order(delivered=T0 - 3.5 * DAY), _order("o2", delivered=T0 + DAY)])
    assert one(delivery.time_stats(w))["fastest_delivery_days"] == -3
    assert [r["delivery_time_group"] for r in rows(delivery.time_groups(w))] == [None, "0-3 days"]


def test_late_rules(spark):
    due = T0 + 5 * DAY
    w = build(spark, customers=CUSTOMER, orders=[
        _order("equal", delivered=due, due=due),
        _order("same day", delivered=due + 2 * HOUR, due=due),
        _order("no estimate", delivered=due),
        _order("not delivered", due=due),
    ])
    mart = {r["order_id"]: r for r in rows(marts.delivery(w))}
    assert mart["equal"]["delivery_status"] == "On Time"
    assert (mart["same day"]["delivery_status"], mart["same day"]["delivery_delay_days"]) == ("Late", 0)
    assert mart["no estimate"]["delivery_status"] == "Late"
    assert "not delivered" not in mart
    assert {r["delivery_status"]: r["order_count"] for r in rows(delivery.ontime_late(w))} == {
        "On Time": 1, "Late": 1}
    assert one(kpi.late_rate(w))["late_orders"] == 1


def test_categories_without_a_name(spark):
    names = {"p1": None, "p2": "", "p3": "   ", "p4": "unknown", "p5": "casa"}
    w = build(spark, customers=CUSTOMER, orders=[_order()],
              order_items=[{"order_id": "o1", "order_item_id": i, "product_id": p} for i, p in enumerate(names)]
              + [{"order_id": "o1", "order_item_id": 9, "product_id": "p9"}],
              products=[{"product_id": p, "product_category_name": n} for p, n in names.items()],
              category_translation=[{"product_category_name": "casa", "product_category_name_english": "home"}])
    shown = {r["product_id"]: r["product_category"] for r in rows(marts.sales(w))}
    assert shown == {"p1": "Uncategorized", "p2": "Uncategorized", "p3": "Uncategorized", "p4": "unknown",
                     "p5": "home", "p9": "Uncategorized"}
    table = {r["product_category"]: r["items"] for r in rows(semantic.category_table(Model(w)))}
    assert table == {"Uncategorized": 4, "unknown": 1, "home": 1}
    sliced = Model(w, Context(categories=("Uncategorized",)))
    assert one(semantic.core(sliced))["items"] == 4


def test_months_without_sales_and_growth_from_zero(spark):
    months = [datetime.datetime(2020, m, 5) for m in (1, 2, 4, 5)]
    w = build(spark, customers=CUSTOMER,
              orders=[_order(f"o{i}", purchase=m) for i, m in enumerate(months)],
              order_items=[{"order_id": f"o{i}", "price": p, "freight_value": "0.00"}
                           for i, p in enumerate(("10.00", "20.00", "30.00", "15.00"))])
    full = {r["sales_month"]: r for r in rows(kpi.monthly_full(w))}
    assert list(full) == ["2020-01", "2020-02", "2020-03", "2020-04", "2020-05"]
    assert (full["2020-03"]["total_orders"], full["2020-03"]["revenue"]) == (0, 0)
    assert full["2020-03"]["average_order_value"] is None
    assert full["2020-03"]["mom_growth_pct"] == Decimal("-100.00")
    assert full["2020-01"]["mom_growth_pct"] is None and full["2020-04"]["mom_growth_pct"] is None
    assert full["2020-05"]["mom_growth_pct"] == Decimal("-50.00")
    gappy = {r["sales_month"]: r["mom_growth_pct"] for r in rows(kpi.monthly_growth(w))}
    assert gappy == {"2020-01": None, "2020-02": 100, "2020-04": 50, "2020-05": -50}

    by_rows = [r["moving_avg_3_months"] for r in rows(advanced.running_and_moving(w))]
    by_months = [r["moving_avg_3_months"] for r in rows(advanced.running_and_moving_gapsafe(w))]
    assert by_rows == [Decimal(x) for x in ("10.00", "15.00", "20.00", "21.67")]
    assert by_months == [Decimal(x) for x in ("10.00", "15.00", "10.00", "16.67", "15.00")]


def test_reviews_and_items_of_one_order(spark):
    w = build(spark, orders=[_order()],
              order_items=[{"order_id": "o1", "order_item_id": 1}, {"order_id": "o1", "order_item_id": 2}],
              reviews=[{"review_id": "r1", "order_id": "o1", "review_score": 5},
                       {"review_id": "r2", "order_id": "o1", "review_score": 2}],
              products=[{"product_id": "p1", "product_category_name": "casa"}])
    fanout, fixed = one(products.category_reviews_fanout(w)), one(products.category_reviews(w))
    assert (fanout["units_sold"], fanout["revenue"], fanout["avg_review_score"]) == (4, 40, Decimal("3.50"))
    assert (fixed["units_sold"], fixed["revenue"], fixed["avg_review_score"]) == (2, 20, Decimal("3.50"))
    assert one(products.reviews_left(w))["units_sold"] == 4
    assert one(sellers.reviews(w))["units_sold"] == 2


def test_products_without_a_review(spark):
    """p1 sells much and is unreviewed; p2 sells little with a good review; p3 little and bad."""
    w = build(spark, orders=[_order(f"o{i}") for i in range(6)],
              order_items=[{"order_id": f"o{i}", "product_id": "p1"} for i in range(4)]
              + [{"order_id": "o4", "product_id": "p2"}, {"order_id": "o5", "product_id": "p3"}],
              reviews=[{"review_id": "r1", "order_id": "o4", "review_score": 5},
                       {"review_id": "r2", "order_id": "o5", "review_score": 1}])
    labels = {r["product_id"]: r["review_category"] for r in rows(products.labels(w))}
    assert labels == {"p1": "Weak Reviews", "p2": "Strong Reviews", "p3": "Weak Reviews"}
    classes = {r["product_id"]: r["performance_category"] for r in rows(products.performance(w))}
    assert classes == {"p1": "Average Performer", "p2": "Average Performer", "p3": "Potential Underperformer"}


def test_installments(spark):
    w = build(spark, payments=[{"order_id": f"o{n}", "payment_installments": n} for n in (0, 1, 2, 6, 9, 10, 24)])
    groups = {r["installment_group"]: r["payment_count"] for r in rows(payments.installment_groups(w))}
    assert groups == {"1 installment": 1, "2-3 installments": 1, "4-6 installments": 1, "7-9 installments": 1,
                      "10+ installments": 2}
    assert {r["installment_type"]: r["payment_count"] for r in rows(payments.installment_share(w))} == {
        "1 installment": 1, "2+ installments": 5}
    assert len(rows(payments.installments(w))) == 7


def test_ranks_keep_ties(spark):
    prices = {"s1": "50.00", "s2": "40.00", "s3": "30.00", "s4": "30.00", "s5": "20.00"}
    w = build(spark, orders=[_order()],
              order_items=[{"order_id": "o1", "order_item_id": i, "seller_id": s, "price": p}
                           for i, (s, p) in enumerate(prices.items())],
              products=[{"product_id": "p1", "product_category_name": "casa"}])
    ranked = [(r["seller_id"], r["seller_rank"]) for r in rows(advanced.seller_rank_in_category(w))]
    assert ranked == [("s1", 1), ("s2", 2), ("s3", 3), ("s4", 3)]


def test_fifths_of_equal_values_follow_the_id(spark):
    people = [f"u{i}" for i in range(7)]
    w = build(spark, customers=[{"customer_id": p} for p in people],
              orders=[_order(f"o{p}", customer_id=p) for p in people],
              order_items=[{"order_id": f"o{p}"} for p in people])
    scores = {r["customer_unique_id"]: r for r in rows(customers.rfm_scores(w))}
    assert [scores[p]["m_score"] for p in people] == [1, 1, 2, 2, 3, 4, 5]
    assert [scores[p]["r_score"] for p in people] == [1, 1, 2, 2, 3, 4, 5]
    assert {scores[p]["f_score"] for p in people} == {1}


@pytest.mark.parametrize(("orders", "score"), [(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 5), (9, 5)])
def test_frequency_steps(spark, orders, score):
    w = build(spark, customers=CUSTOMER, orders=[_order(f"o{i}") for i in range(orders)],
              order_items=[{"order_id": f"o{i}"} for i in range(orders)])
    assert one(customers.rfm_scores(w))["f_score"] == score


def test_recency_uses_all_orders_as_anchor_or_a_given_day(spark):
    w = build(spark, customers=[{"customer_id": "c1"}, {"customer_id": "c2"}],
              orders=[_order("o1"), _order("o2", purchase=T0 + 100 * DAY, customer_id="c2")],
              order_items=[{"order_id": "o1"}])
    assert one(customers.recency(w))["recency_days"] == 100
    assert one(customers.recency(w, datetime.date(2020, 1, 12)))["recency_days"] == 2


def test_person_with_two_customer_ids(spark):
    w = build(spark, customers=[{"customer_id": "c1", "customer_unique_id": "u", "customer_state": "AA",
                                 "customer_city": "zoo"},
                                {"customer_id": "c2", "customer_unique_id": "u", "customer_state": "ZZ",
                                 "customer_city": "abc"}],
              orders=[_order("o1"), _order("o2", customer_id="c2", purchase=T0 + 40 * DAY),
                      _order("o3", customer_id="c2", order_status="canceled")],
              order_items=[{"order_id": o} for o in ("o1", "o2", "o3")])
    person = one(marts.customers(w))
    assert (person["customer_city"], person["customer_state"], person["total_orders"]) == ("zoo", "ZZ", 2)
    assert person["customer_type"] == "Repeat Customer"
    latest = one(marts.customers(w, latest_place=True))
    assert (latest["customer_city"], latest["customer_state"]) == ("abc", "ZZ")
    assert one(customers.profile(w))["order_count"] == 3
    cohort = rows(advanced.cohort_retention(w))
    assert [(r["months_since_first_purchase"], r["active_customers"], r["cohort_size"]) for r in cohort] == [
        (0, 1, 1), (1, 1, 1)]


def test_price_cutoff_and_fallback_sentences(spark):
    w = build(spark, customers=CUSTOMER, orders=[_order()],
              order_items=[{"order_id": "o1", "order_item_id": i, "product_id": p, "price": price}
                           for i, (p, price) in enumerate([("p1", "10.00")] * 5 + [("p2", "99.00")] * 4)],
              products=[{"product_id": "p1", "product_category_name": "a"},
                        {"product_id": "p2", "product_category_name": "b"}])
    assert one(semantic.top_price_category(Model(w)))["product_category"] == "a"
    said = {r["topic"]: r["sentence"] for r in rows(semantic.takeaways(Model(w)))}
    assert said["price"] == "Highest average price: a (10.00)"
    assert said["freight"] == semantic.NOTHING
    assert said["late reviews"] == semantic.NOTHING


@pytest.mark.parametrize(("orders", "listed"), [(99, 0), (100, 1)])
def test_minimum_orders_per_state(spark, orders, listed):
    w = build(spark, customers=CUSTOMER, orders=[_order(f"o{i}") for i in range(orders)],
              order_items=[{"order_id": f"o{i}"} for i in range(orders)])
    assert len(rows(semantic.freight_by_state(Model(w)))) == listed


def test_status_filter_leaves_the_denominator_alone(spark):
    due = T0 + 5 * DAY
    w = build(spark, customers=CUSTOMER, orders=[
        _order("o1", delivered=due, due=due), _order("o2", delivered=due, due=due),
        _order("o3", delivered=due + DAY, due=due)])
    late = one(semantic.ontime_pct(Model(w, Context(delivery_statuses=("Late",)))))
    assert (late["on_time_orders"], late["delivered_orders"], late["on_time_pct"]) == (0, 3, 0)
    on_time = one(semantic.ontime_pct(Model(w, Context(delivery_statuses=("On Time",)))))
    assert on_time["on_time_pct"] == Decimal("66.67")


def test_customer_type_comes_from_the_whole_history(spark):
    w = build(spark, customers=[{"customer_id": "c1"}, {"customer_id": "c2"}],
              orders=[_order("o1"), _order("o2", purchase=T0 + 60 * DAY), _order("o3", customer_id="c2")],
              order_items=[{"order_id": o} for o in ("o1", "o2", "o3")])
    january = Model(w, Context(date_to=datetime.date(2020, 1, 31)))
    assert one(semantic.repeat_rate(january))["repeat_rate_pct"] == 50
    share = rows(semantic.revenue_share_by_type(Model(w, Context(
        date_to=datetime.date(2020, 1, 31), customer_types=("Repeat Customer",)))))
    assert [(r["customer_type"], r["share_pct"]) for r in share] == [("Repeat Customer", 50)]


def test_empty_selection_gives_blanks(spark):
    w = build(spark, customers=CUSTOMER, orders=[_order()], order_items=[{"order_id": "o1"}])
    nothing = Model(w, Context(states=("XX",)))
    core = one(semantic.core(nothing))
    assert core["orders"] == 0 and core["revenue"] is None and core["aov"] is None
    assert one(semantic.freight_pct(nothing))["freight_pct"] is None


def test_a_share_is_rounded_once(spark):
    """62.449 shows as 62.4, not by way of 62.45 as 62.5."""
    from orderlens.functions import pct
    row = spark.createDataFrame([(62449, 100000)], "a long, b long").select(pct("a", "b", 1)).first()
    assert str(row[0]) == "62.4"


def test_a_repeated_order_counts_once(spark):
    from orderlens.plans import kpi
    from orderlens.warehouse import Warehouse
    stamp = datetime.datetime(2020, 1, 1)
    rows = [("a", "canceled"), ("a", "canceled"), ("b", "delivered"), ("c", "shipped")]
    orders = spark.createDataFrame([(i, s, stamp, stamp, stamp) for i, s in rows], "order_id string, order_status string, "
                                   "order_purchase_timestamp timestamp_ntz, order_delivered_customer_date timestamp_ntz, "
                                   "order_estimated_delivery_date timestamp_ntz")
    row = kpi.cancellation(Warehouse.of(spark, orders=orders)).first()
    assert (row.total_orders, row.cancelled_orders, str(row.cancellation_rate_pct)) == (3, 1, "33.33")


def test_scratch_is_removed_when_closed(spark, tmp_path):
    import os

    from orderlens.session import Scratch, scratch_table
    with Scratch(spark, "own") as scratch:
        kept = scratch.keep(spark.range(3).toDF("id"), "numbers")
        other = scratch.keep(spark.range(3).toDF("id"), "numbers")
        scratch.remove(kept)
        assert other.count() == 3 and len(os.listdir(scratch.path)) == 1
    assert not os.path.exists(scratch.path)
    name = scratch_table(spark, "t")
    spark.range(1).write.saveAsTable(name)
    assert spark.catalog.tableExists(name)
