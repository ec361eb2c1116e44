"""The dashboard model: slicers that flow along single-direction relationships, and measures.

A ``Model`` is the warehouse under a ``Context``. Date and state narrow the order
register, which narrows every fact; category and customer type reach sales only;
delivery status reaches the register and so every fact.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions import (
    LATE, ON_TIME, count_when, delivery_status, is_delivered, mean, money,
    money_sum, money_total, month_start, pct, ratio,
)
from orderlens.operators.calendar import date_dim
from orderlens.operators.ranking import global_row_number, top_n
from orderlens.operators.rollups import item_totals, review_totals
from orderlens.plans import marts
from orderlens.session import materialize
from orderlens.warehouse import Warehouse

# Fixed values of the report pages.
TREND_START = datetime.date(2017, 1, 1)
MIN_ORDERS = 100
MAX_INSTALLMENTS = 10
PRICE_CUTOFF_ITEMS, PRICE_CUTOFF_SHARE = 5, 1000  # at least 5 items and a thousandth of the selection

_STATE, _PERSON = "customer_state", "customer_unique_id"


@dataclass(frozen=True)
class Context:
    """Slicer selection; an empty field selects everything."""

    date_from: datetime.date | None = None
    date_to: datetime.date | None = None
    states: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    delivery_statuses: tuple[str, ...] = ()
    customer_types: tuple[str, ...] = ()

    def without(self, *names: str) -> Context:
        """The same context with some filters removed, for denominators."""
        return replace(self, **{n: None if n.startswith("date_") else () for n in names})


@dataclass(frozen=True)
class Model:
    warehouse: Warehouse
    context: Context = Context()

    def without(self, *names: str) -> Model:
        return Model(self.warehouse, self.context.without(*names))

    def _all_orders(self, buyer: bool, how: str = "inner") -> DataFrame:
        """Delivered orders before any slicer. Unused columns are pruned from the scan;
        the customer join is left out where neither buyer nor place is needed."""
        orders = self.warehouse.orders.filter(is_delivered())
        if buyer:
            orders = orders.join(self.warehouse.customers, "customer_id", how)
        arrived = F.col("order_delivered_customer_date")
        return orders.select(
            "order_id", *([_PERSON, _STATE] if buyer else []),
            F.to_date("order_purchase_timestamp").alias("order_date"),
            F.datediff(arrived, "order_purchase_timestamp").alias("delivery_days"),
            F.datediff(arrived, "order_estimated_delivery_date").alias("delivery_delay_days"),
            F.when(arrived.isNotNull(), delivery_status(missing_is_late=True)).alias("delivery_status"),
        )

    def orders(self, buyer: bool = True, how: str = "inner") -> DataFrame:
        """The register under the date, state and delivery status slicers. ``how`` is the join with the buyers."""
        context = self.context
        orders = self._all_orders(buyer or bool(context.states), how)
        if context.date_from:
            orders = orders.filter(F.col("order_date") >= F.lit(context.date_from))
        if context.date_to:
            orders = orders.filter(F.col("order_date") <= F.lit(context.date_to))
        if context.states:
            orders = orders.filter(F.col(_STATE).isin(*context.states))
        if context.delivery_statuses:
            orders = orders.filter(F.col("delivery_status").isin(*context.delivery_statuses))
        return orders

    def delivery(self, buyer: bool = False) -> DataFrame:
        """Orders of the register that have a delivery date."""
        return self.orders(buyer).filter(F.col("delivery_status").isNotNull())

    def reviews(self, buyer: bool = False) -> DataFrame:
        """Review totals per order of the register."""
        return review_totals(self.warehouse.reviews).join(self.orders(buyer), "order_id")

    def payments(self) -> DataFrame:
        return self.warehouse.payments.join(self.orders(buyer=False).select("order_id"), "order_id", "left_semi")

    def _buyers(self, buyer: bool) -> DataFrame:
        """Orders whose buyers are of the selected customer types."""
        orders = self.orders(buyer or bool(self.context.customer_types))
        if not self.context.customer_types:
            return orders
        chosen = people_types(self.warehouse).filter(F.col("customer_type").isin(*self.context.customer_types))
        return orders.join(chosen.select(_PERSON), _PERSON, "left_semi")

    def _sold(self) -> DataFrame:
        """Items under the category slicer; products without a match are Uncategorized."""
        items = self.warehouse.order_items
        if not self.context.categories:
            return items
        wanted = F.col("product_category").isin(*self.context.categories)
        listed = marts.product_categories(self.warehouse)
        if marts.UNCATEGORIZED in self.context.categories:
            return items.join(listed.filter(~wanted).select("product_id"), "product_id", "left_anti")
        return items.join(listed.filter(wanted).select("product_id"), "product_id", "left_semi")

    def order_sales(self, buyer: bool = False) -> DataFrame:
        """Sales per order: items, revenue, freight beside the order's attributes."""
        totals = item_totals(self._sold(), "order_id").join(self._buyers(buyer), "order_id")
        return totals.withColumns({"revenue": money("revenue_cents"), "freight": money("freight_cents")})

    def sales_by(self, key: str) -> DataFrame:
        """Sales per item attribute (product_id or seller_id)."""
        sold = self._sold().join(self._buyers(False).select("order_id"), "order_id", "left_semi")
        return item_totals(sold, key).select(
            key, "items", money("revenue_cents").alias("revenue"), money("freight_cents").alias("freight"))

    def category_sales(self) -> DataFrame:
        per_product = self.sales_by("product_id").join(
            marts.product_categories(self.warehouse), "product_id", "left")
        name = F.coalesce("product_category", F.lit(marts.UNCATEGORIZED))
        return per_product.groupBy(name.alias("product_category")).agg(
            F.sum("items").alias("items"), F.sum("revenue").alias("revenue"), F.sum("freight").alias("freight"))


def people_types(w: Warehouse) -> DataFrame:
    """Customer type from the whole history of delivered orders, whatever is selected."""
    sold = w.order_items.select("order_id").distinct()
    per_customer = w.orders.filter(is_delivered()).select("order_id", "customer_id").join(
        sold, "order_id", "left_semi").groupBy("customer_id").agg(F.count("*").alias("n"))
    return per_customer.join(w.customers.select("customer_id", _PERSON), "customer_id").groupBy(_PERSON).agg(
        marts.customer_type(F.sum("n")).alias("customer_type"))


# Relationships: one side, many side, key. Filters flow from the first to the second.
RELATIONSHIPS = (
    ("date", "orders", "order_purchase_date"),
    ("orders", "sales", "order_id"),
    ("orders", "reviews", "order_id"),
    ("orders", "payments", "order_id"),
    ("orders", "delivery", "order_id"),
    ("products", "sales", "product_id"),
    ("sellers", "sales", "seller_id"),
    ("customers", "sales", "customer_unique_id"),
)


def _keys(frame: DataFrame, *uses: tuple[int, str, bool]) -> DataFrame:
    """(relationship, key, one): a row of the frame for every use, on the one side or the many side of a relationship."""
    rows = F.array(*[F.struct(F.lit(number).alias("relationship"), F.col(key).cast("string").alias("key"), F.lit(one).alias("one"))
                     for number, key, one in uses])
    return frame.select(F.explode(rows).alias("use")).select("use.*")


def star_relationships(w: Warehouse) -> DataFrame:
    """Every relationship with its checks: the one side has unique keys and no many-side key is an orphan.

    The keys of all sides go through one grouping. The register, and the keys of the sides that are reports of their own, are
    written once below the shared folder.
    """
    number = {(one, many): i for i, (one, many, _) in enumerate(RELATIONSHIPS, 1)}
    by_order = [i for (one, _), i in number.items() if one == "orders"]
    hub = materialize(marts.delivered_hub(w, "order_id", F.to_date("order_purchase_timestamp").alias("order_purchase_date"), _PERSON), "star-register")
    reports = [_keys(date_dim(w.orders).select(F.col("date").alias("day")), (number["date", "orders"], "day", True))]
    for name, mart, key in (("products", marts.products(w), "product_id"), ("sellers", marts.sellers(w), "seller_id"),
                            ("customers", marts.customers(w), _PERSON)):
        reports.append(_keys(mart.select(key), (number[name, "sales"], key, True)))
    reports.append(_keys(marts.delivery(w).select("order_id"), (number["orders", "delivery"], "order_id", False)))
    sold = w.order_items.select("order_id", "product_id", "seller_id").join(hub.select("order_id", _PERSON), "order_id")
    order_ids = hub.select("order_id")
    tagged = [
        materialize(reduce(DataFrame.unionAll, reports), "star-keys"),
        _keys(hub, (number["date", "orders"], "order_purchase_date", False), *[(i, "order_id", True) for i in by_order]),
        _keys(sold, *[(number[one, "sales"], key, False) for one, key in (
            ("orders", "order_id"), ("products", "product_id"), ("sellers", "seller_id"), ("customers", _PERSON))]),
        _keys(w.reviews.select("order_id").join(order_ids, "order_id", "left_semi"), (number["orders", "reviews"], "order_id", False)),
        _keys(w.payments.select("order_id").join(order_ids, "order_id", "left_semi"), (number["orders", "payments"], "order_id", False)),
    ]
    keys = reduce(DataFrame.unionAll, tagged).groupBy("relationship", "key").agg(
        count_when(F.col("one")).alias("one"), count_when(~F.col("one")).alias("many"))
    found = keys.groupBy("relationship").agg(
        F.nullif(F.sum("one"), F.lit(0)).alias("one_rows"), count_when(F.col("one") > 0).alias("one_keys"),
        count_when((F.col("one") == 0) & (F.col("many") > 0)).alias("orphan_keys"))
    listed = F.array(*[F.struct(F.lit(i).alias("relationship"), F.lit(one).alias("one_side"), F.lit(many).alias("many_side"),
                                F.lit(key).alias("key")) for i, (one, many, key) in enumerate(RELATIONSHIPS, 1)])
    every = w.spark.range(1).select(F.explode(listed).alias("r")).select("r.*")
    return every.join(found, "relationship", "left").select(
        "relationship", "one_side", "many_side", "key", "one_rows", F.coalesce("one_keys", F.lit(0)).alias("one_keys"),
        F.coalesce("orphan_keys", F.lit(0)).alias("orphan_keys"))


# --- Overview and sales -----------------------------------------------------------------------

def core(m: Model) -> DataFrame:
    return m.order_sales(buyer=True).agg(
        F.sum("revenue").alias("revenue"),
        F.count("*").alias("orders"),
        F.sum("items").alias("items"),
        ratio(F.sum("revenue"), F.count("*")).alias("aov"),
        F.count_distinct(_PERSON).alias("customers"),
        F.sum("freight").alias("freight"),
    )


def freight_pct(m: Model) -> DataFrame:
    return m.order_sales().agg(pct(F.sum("freight"), F.sum("revenue")).alias("freight_pct"))


def avg_item_price(m: Model) -> DataFrame:
    return m.order_sales().agg(ratio(F.sum("revenue"), F.sum("items")).alias("avg_item_price"))


def category_table(m: Model, n: int = 10) -> DataFrame:
    table = m.category_sales().select(
        "product_category", "revenue", "items",
        ratio("revenue", "items").alias("avg_item_price"), pct("freight", "revenue").alias("freight_pct"))
    return top_n(table, n, F.col("revenue").desc(), F.col("product_category"))


def _states(m: Model) -> DataFrame:
    return m.order_sales(buyer=True).groupBy(_STATE).agg(
        F.sum("revenue").alias("revenue"), F.sum("freight").alias("freight"), F.count("*").alias("orders"))


def _freight_by_state(m: Model, min_orders: int) -> DataFrame:
    return _states(m).filter(F.col("orders") >= min_orders).select(
        _STATE, pct("freight", "revenue").alias("freight_pct"), "orders")


def freight_by_state(m: Model, n: int = 8, min_orders: int = MIN_ORDERS) -> DataFrame:
    return top_n(_freight_by_state(m, min_orders), n, F.col("freight_pct").desc(), F.col(_STATE))


def top_freight_state(m: Model, min_orders: int = MIN_ORDERS) -> DataFrame:
    return freight_by_state(m, 1, min_orders).drop("orders")


def top10_category_share(m: Model, n: int = 10, digits: int = 2) -> DataFrame:
    categories = m.category_sales()
    top = top_n(categories, n, F.col("revenue").desc(), F.col("product_category"))
    return top.agg(F.sum("revenue").alias("top_revenue")).select(
        "top_revenue", categories.agg(F.sum("revenue")).scalar().alias("revenue"),
    ).withColumn("share_pct", pct("top_revenue", "revenue", digits))


def top_price_category(m: Model) -> DataFrame:
    """Highest average price among categories above the cut-off; no row when none qualifies."""
    priced = m.category_sales()
    total = priced.agg(F.sum("items")).scalar()
    enough = (F.col("items") >= PRICE_CUTOFF_ITEMS) & (F.col("items") * PRICE_CUTOFF_SHARE >= total)
    table = priced.filter(enough).select("product_category", ratio("revenue", "items").alias("avg_item_price"))
    return top_n(table, 1, F.col("avg_item_price").desc(), F.col("product_category"))


def monthly_revenue(m: Model, start: datetime.date = TREND_START) -> DataFrame:
    return m.order_sales().filter(F.col("order_date") >= F.lit(start)).groupBy(
        month_start("order_date").alias("month")).agg(F.sum("revenue").alias("revenue")).orderBy("month")


def top_categories(m: Model, n: int = 10) -> DataFrame:
    return top_n(m.category_sales().select("product_category", "revenue"), n,
                 F.col("revenue").desc(), F.col("product_category"))


def top_states(m: Model, n: int = 10) -> DataFrame:
    return top_n(_states(m).select(_STATE, "revenue"), n, F.col("revenue").desc(), F.col(_STATE))


def top_categories_states(m: Model, n: int = 10) -> DataFrame:
    """Both charts in one frame."""
    categories = top_categories(m, n).select(
        F.lit("category").alias("chart"), F.col("product_category").alias("name"), "revenue")
    states = top_states(m, n).select(F.lit("state").alias("chart"), F.col(_STATE).alias("name"), "revenue")
    return categories.unionAll(states)


# --- Sellers and delivery ---------------------------------------------------------------------

def ontime_pct(m: Model) -> DataFrame:
    """On-time orders of the selection over all delivered orders: the denominator drops the status filter."""
    everything = m.without("delivery_statuses").delivery().agg(F.count("*"))
    return m.delivery().agg(count_when(F.col("delivery_status") == ON_TIME).alias("on_time_orders")).select(
        "on_time_orders", everything.scalar().alias("delivered_orders"),
    ).withColumn("on_time_pct", pct("on_time_orders", "delivered_orders"))


def avg_delivery_days(m: Model) -> DataFrame:
    return m.delivery().agg(mean("delivery_days").alias("avg_delivery_days"))


def late_orders(m: Model) -> DataFrame:
    return m.delivery().agg(count_when(F.col("delivery_status") == LATE).alias("late_orders"))


def avg_days_late(m: Model) -> DataFrame:
    late = F.when(F.col("delivery_status") == LATE, F.col("delivery_delay_days"))
    return m.delivery().agg(mean(late).alias("avg_days_late"))


def active_sellers(m: Model) -> DataFrame:
    return m.sales_by("seller_id").agg(F.count("*").alias("active_sellers"))


def delivered_orders(m: Model) -> DataFrame:
    return m.delivery().agg(F.count("*").alias("delivered_orders"))


def _reviews_by_status(m: Model, *measures: Column) -> DataFrame:
    return m.reviews().filter(F.col("delivery_status").isNotNull()).groupBy("delivery_status").agg(
        *measures).orderBy("delivery_status")


def _review_mean() -> Column:
    return ratio(F.sum("score"), F.sum("reviews")).alias("avg_review_score")


def review_by_status(m: Model) -> DataFrame:
    return _reviews_by_status(m, _review_mean())


def slowest_states(m: Model, n: int = 8, min_orders: int = MIN_ORDERS) -> DataFrame:
    states = m.delivery(buyer=True).groupBy(_STATE).agg(
        mean("delivery_days").alias("avg_delivery_days"), F.count("*").alias("orders"))
    return top_n(states.filter(F.col("orders") >= min_orders), n, F.col("avg_delivery_days").desc(), F.col(_STATE))


def delivery_histogram(m: Model, width: int = 5) -> DataFrame:
    bucket = (F.floor(F.col("delivery_days") / width) * width).cast("int")
    return m.delivery().groupBy(bucket.alias("days_from")).agg(F.count("*").alias("orders")).orderBy("days_from")


def revenue_by_seller_state(m: Model, n: int = 8) -> DataFrame:
    places = m.warehouse.sellers.select("seller_id", "seller_state")
    states = m.sales_by("seller_id").join(places, "seller_id", "left").groupBy("seller_state").agg(
        F.sum("revenue").alias("revenue"), F.count("*").alias("active_sellers"))
    return top_n(states, n, F.col("revenue").desc(), F.col("seller_state"))


def top_decile_seller_share(m: Model, tenths: int = 1, digits: int = 2) -> DataFrame:
    """Revenue share of the best tenth of sellers, their number rounded up."""
    return _top_decile(m.sales_by("seller_id").select("seller_id", "revenue"), tenths, digits)


def _top_decile(sellers: DataFrame, tenths: int, digits: int) -> DataFrame:
    ranked = global_row_number(sellers, [F.col("revenue").desc(), F.col("seller_id")], "position", "sellers")
    chosen = F.col("position") <= F.floor((F.col("sellers") * tenths + 9) / 10)
    return ranked.agg(
        count_when(chosen).alias("top_sellers"),
        pct(F.sum(F.when(chosen, F.col("revenue"))), F.sum("revenue"), digits).alias("share_pct"))


def status_split(m: Model) -> DataFrame:
    groups = m.delivery().groupBy("delivery_status").agg(F.count("*").alias("orders"))
    share = pct(F.col("orders"), F.sum("orders").over(Window.partitionBy()))
    return groups.withColumn("share_pct", share).orderBy("delivery_status")


# --- Customers --------------------------------------------------------------------------------

def _people(m: Model) -> DataFrame:
    """Buyers of the selection with orders and revenue in it and their type over all time."""
    bought = m.order_sales(buyer=True).groupBy(_PERSON).agg(F.count("*").alias("orders"), F.sum("revenue").alias("revenue"))
    if m.context == Context():  # the selection is the whole history
        return bought.withColumn("customer_type", marts.customer_type(F.col("orders")))
    return bought.join(people_types(m.warehouse), _PERSON)


def repeat_rate(m: Model) -> DataFrame:
    repeat = count_when(F.col("customer_type") == marts.REPEAT)
    return _people(m).agg(
        repeat.alias("repeat_customers"), F.count("*").alias("customers"),
        pct(repeat, F.count("*")).alias("repeat_rate_pct"))


def orders_per_customer(m: Model) -> DataFrame:
    return m.order_sales(buyer=True).agg(ratio(F.count("*"), F.count_distinct(_PERSON)).alias("orders_per_customer"))


def revenue_per_customer(m: Model) -> DataFrame:
    return m.order_sales(buyer=True).agg(ratio(F.sum("revenue"), F.count_distinct(_PERSON)).alias("revenue_per_customer"))


def customers_by_type(m: Model) -> DataFrame:
    return _people(m).groupBy("customer_type").agg(F.count("*").alias("customers")).orderBy("customer_type")


def new_customers_month(m: Model, start: datetime.date = TREND_START) -> DataFrame:
    """Buyers of the selection by the month of their first delivered purchase ever."""
    everyone = Model(m.warehouse).order_sales(buyer=True).groupBy(_PERSON).agg(
        month_start(F.min("order_date")).alias("month"))
    chosen = everyone.filter(F.col("month") >= F.lit(start))
    if m.context != Context():
        chosen = chosen.join(
            m.order_sales(buyer=True).select(_PERSON).distinct(), _PERSON, "left_semi")
    return chosen.groupBy("month").agg(F.count("*").alias("new_customers")).orderBy("month")


def _state_people(m: Model) -> DataFrame:
    """Buyers and revenue by state. A person seen in two states counts in both."""
    per_person = m.order_sales(buyer=True).groupBy(_STATE, _PERSON).agg(F.sum("revenue").alias("revenue"))
    return per_person.groupBy(_STATE).agg(F.count("*").alias("customers"), F.sum("revenue").alias("revenue"))


def customers_by_state(m: Model, n: int = 6, digits: int = 2) -> DataFrame:
    people = m.order_sales(buyer=True).agg(F.count_distinct(_PERSON)).scalar()
    table = _state_people(m).select(_STATE, "customers", pct(F.col("customers"), people, digits).alias("share_pct"))
    return top_n(table, n, F.col("customers").desc(), F.col(_STATE))


def revenue_share_by_type(m: Model, digits: int = 2) -> DataFrame:
    """The denominator drops the customer type filter and keeps all others."""
    everything = m.without("customer_types").order_sales().agg(F.sum("revenue")).scalar()
    groups = _people(m).groupBy("customer_type").agg(F.sum("revenue").alias("revenue"))
    return groups.withColumn("share_pct", pct(F.col("revenue"), everything, digits)).orderBy("customer_type")


def state_customer_revenue_share(m: Model) -> DataFrame:
    totals = m.order_sales(buyer=True).agg(F.struct(
        F.count_distinct(_PERSON).alias("customers"), F.sum("revenue").alias("revenue"))).scalar()
    return _state_people(m).withColumn("total", totals).select(
        _STATE,
        pct(F.col("customers"), F.col("total.customers")).alias("customer_share_pct"),
        pct(F.col("revenue"), F.col("total.revenue")).alias("revenue_share_pct"),
    ).orderBy(_STATE)


# --- Reviews and payments ---------------------------------------------------------------------

def review_trend(m: Model, start: datetime.date = TREND_START) -> DataFrame:
    return m.reviews().filter(F.col("order_date") >= F.lit(start)).groupBy(
        month_start("order_date").alias("month"),
    ).agg(_review_mean(), F.sum("reviews").alias("reviews")).orderBy("month")


def lowest_rated_states(m: Model, n: int = 8, min_orders: int = 1) -> DataFrame:
    states = m.reviews(buyer=True).groupBy(_STATE).agg(_review_mean(), F.count("*").alias("orders"))
    return top_n(states.filter(F.col("orders") >= min_orders).drop("orders"), n,
                 F.col("avg_review_score"), F.col(_STATE))


def _scores(m: Model) -> DataFrame:
    """Single reviews of the register's orders with the order's delivery status."""
    return m.warehouse.reviews.select("order_id", "review_score").groupBy("order_id", "review_score").agg(
        F.count("*").alias("n")).join(m.orders(buyer=False).select("order_id", "delivery_status"), "order_id")


def _low_share() -> list[Column]:
    low = F.coalesce(F.sum(F.when(F.col("review_score") <= 2, F.col("n"))), F.lit(0))
    return [low.alias("low_reviews"), F.sum("n").alias("reviews"), pct(low, F.sum("n")).alias("low_score_pct")]


def avg_review_score(m: Model) -> DataFrame:
    """Average score of the selection's reviews; null when it has none."""
    return m.reviews().agg(_review_mean())


def review_count(m: Model) -> DataFrame:
    return m.reviews().agg(F.coalesce(F.sum("reviews"), F.lit(0)).alias("reviews"))


def low_score_share(m: Model) -> DataFrame:
    return _scores(m).agg(*_low_share())


def low_score_by_status(m: Model) -> DataFrame:
    return _scores(m).filter(F.col("delivery_status").isNotNull()).groupBy("delivery_status").agg(
        *_low_share()).orderBy("delivery_status")


def review_distribution(m: Model) -> DataFrame:
    return _scores(m).groupBy("review_score").agg(F.sum("n").alias("reviews")).orderBy("review_score")


def payment_mix(m: Model, digits: int = 2) -> DataFrame:
    groups = m.payments().groupBy("payment_type").agg(F.sum("payment_value").alias("payment_value"))
    share = pct(F.col("payment_value"), F.sum("payment_value").over(Window.partitionBy()), digits)
    return groups.withColumn("share_pct", share).orderBy(F.col("payment_value").desc(), "payment_type")


def total_payment_value(m: Model) -> DataFrame:
    return m.payments().agg(F.sum("payment_value").alias("payment_value"))


def _card(m: Model) -> DataFrame:
    return m.payments().filter(F.col("payment_type") == "credit_card")


def avg_installments_cc(m: Model) -> DataFrame:
    return _card(m).agg(mean("payment_installments").alias("avg_installments"))


def cc_payments(m: Model) -> DataFrame:
    return _card(m).agg(F.count("*").alias("payments"))


def cc_installments(m: Model) -> DataFrame:
    return _card(m).filter(F.col("payment_installments").between(1, MAX_INSTALLMENTS)).groupBy(
        F.col("payment_installments").alias("installments")).agg(
        F.count("*").alias("payments")).orderBy("installments")


def payment_reconciliation(m: Model) -> DataFrame:
    """Payments of the selection against price plus freight."""
    paid = m.payments().agg(F.sum("payment_value").alias("payments"))
    billed = m.order_sales().agg(F.sum(F.col("revenue") + F.col("freight"))).scalar()
    return paid.select("payments", billed.alias("billed")).withColumn(
        "difference", F.col("payments") - F.col("billed"))


def reconciliation_by_order(m: Model) -> DataFrame:
    """Orders of the register whose payments differ from price plus freight; a missing side is zero."""
    paid = m.payments().groupBy("order_id").agg(money_sum("payment_value").alias("payments"))
    billed = m.order_sales().select("order_id", (F.col("revenue") + F.col("freight")).alias("billed"))
    zero = F.lit(0)
    return paid.join(billed, "order_id", "full").select(
        "order_id", F.coalesce("payments", zero).alias("payments"), F.coalesce("billed", zero).alias("billed"),
    ).withColumn("difference", F.col("payments") - F.col("billed")).filter(F.col("difference") != 0)


# --- Takeaways --------------------------------------------------------------------------------

NOTHING = "Not enough data in this selection"


def _cells(m: Model) -> DataFrame:
    """The selection in one frame of (state, person, delivery status) with the sums that takeaways need, from one pass over
    each fact. Orders without a known buyer have no state and person."""
    w, status, c = m.warehouse, F.col("delivery_status"), F.col
    scores = w.reviews.groupBy("order_id").agg(
        F.count("review_score").alias("reviews"), F.count("*").alias("all_reviews"), F.sum("review_score").alias("score"),
        count_when(c("review_score") <= 2).alias("low"))
    paid = w.payments.groupBy("order_id").agg(
        F.sum("payment_value").alias("paid"), F.sum(F.when(c("payment_type") == "credit_card", c("payment_value"))).alias("card"))
    frame = m.orders(buyer=True, how="left")
    for totals in (item_totals(m._sold(), "order_id"), scores, paid):
        frame = frame.join(totals, "order_id", "left")
    sold = c("items").isNotNull()
    if m.context.customer_types:
        chosen = people_types(w).filter(c("customer_type").isin(*m.context.customer_types)).select(_PERSON, F.lit(True).alias("chosen"))
        frame = frame.join(chosen, _PERSON, "left")
        sold = sold & F.coalesce("chosen", F.lit(False))
    return frame.groupBy(_STATE, _PERSON, "delivery_status").agg(
        count_when(sold).alias("orders"), F.sum(F.when(sold, c("revenue_cents"))).alias("revenue"),
        F.sum(F.when(sold, c("freight_cents"))).alias("freight"), F.sum("revenue_cents").alias("all_revenue"),
        F.count(status).alias("delivered"), F.sum(F.when(status.isNotNull(), c("delivery_days"))).alias("days"),
        F.count(F.when(status.isNotNull(), c("delivery_days"))).alias("timed"),
        F.count("reviews").alias("reviewed"), F.sum("reviews").alias("reviews"), F.sum("score").alias("score"),
        F.sum("all_reviews").alias("all_reviews"), F.sum(F.when(c("all_reviews").isNotNull(), c("low"))).alias("low"),
        F.sum("paid").alias("paid"), F.sum("card").alias("card"))


def _first(value: str, wanted: Column, down: bool) -> Column:
    """The first state by a value, ties by name, among rows that qualify: a struct (value, state)."""
    key = -F.col(value) if down else F.col(value)
    first = F.min(F.when(wanted & F.col(value).isNotNull(), F.struct(key.alias("key"), F.col(_STATE).alias("state"))))
    return F.struct((-first["key"] if down else first["key"]).alias("value"), first["state"].alias("state"))


def _of_states(cells: DataFrame) -> DataFrame:
    """One row: the leading state of every state report, and all buyers."""
    c = F.col
    known = c(_PERSON).isNotNull()
    people = cells.filter(known).groupBy(_STATE, _PERSON).agg(*[F.sum(x).alias(x) for x in (
        "orders", "revenue", "freight", "delivered", "days", "timed", "reviewed", "reviews", "score")])
    states = people.groupBy(_STATE).agg(
        count_when(c("orders") > 0).alias("people"), F.sum("orders").alias("orders"),
        pct(money_total("freight"), money_total("revenue")).alias("freight_pct"), F.sum("delivered").alias("delivered"),
        ratio(F.sum("days"), F.sum("timed")).alias("days"), F.sum("reviewed").alias("reviewed"),
        ratio(F.sum("score"), F.sum("reviews")).alias("score"))
    return states.agg(
        _first("freight_pct", c("orders") >= MIN_ORDERS, True).alias("freight"),
        _first("days", c("delivered") >= MIN_ORDERS, True).alias("slowest"),
        _first("people", c("people") > 0, True).alias("most"), _first("score", c("reviewed") >= 1, False).alias("lowest"))


def _of_people(m: Model, cells: DataFrame) -> DataFrame:
    """One row: buyers of the selection, those that came back, and what these spent."""
    c = F.col
    bought = cells.filter(c(_PERSON).isNotNull()).groupBy(_PERSON).agg(
        F.sum("orders").alias("orders"), F.sum("revenue").alias("revenue")).filter("orders > 0")
    if m.context == Context():  # the selection is the whole history
        bought = bought.withColumn("customer_type", marts.customer_type(c("orders")))
    else:
        bought = bought.join(people_types(m.warehouse), _PERSON)
    repeat = c("customer_type") == marts.REPEAT
    return bought.agg(F.count("*").alias("people"), count_when(repeat).alias("repeat"), money_total(F.when(repeat, c("revenue"))).alias("revenue"))


def _of_all(cells: DataFrame) -> DataFrame:
    """One row: revenue of all types, reviews by delivery status, payments."""
    c = F.col
    late, on_time = c("delivery_status") == LATE, c("delivery_status") == ON_TIME

    def score(wanted: Column) -> Column:
        return ratio(F.sum(F.when(wanted, c("score"))), F.sum(F.when(wanted, c("reviews"))))

    return cells.agg(
        money_total("all_revenue").alias("revenue"), score(late).alias("late"), score(on_time).alias("on_time"),
        pct(F.sum(F.when(late, c("low"))), F.sum(F.when(late, c("all_reviews")))).alias("low"),
        pct(F.sum("card"), F.sum("paid"), 1).alias("card"),
        # Revenue by person counts people; the buyers of several states count once here.
        F.count_distinct(F.when(c("orders") > 0, c(_PERSON))).alias("people"))


def takeaways(m: Model) -> DataFrame:
    """The sentences of all report pages. Shares are rounded once, to the decimal that is shown.

    Three frames are written once below the shared folder: cells of (state, person, delivery status), sales by product and
    seller, and sales by category. All sentences come from these.
    """
    c = F.col
    cells = materialize(_cells(m), "takeaway-cells")
    sold = m._sold().join(m._buyers(False).select("order_id"), "order_id", "left_semi")
    pairs = materialize(item_totals(sold, "product_id", "seller_id"), "takeaway-pairs")
    sums = [F.sum(x).alias(x) for x in ("items", "revenue_cents")]
    per_product = pairs.groupBy("product_id").agg(*sums).join(marts.product_categories(m.warehouse), "product_id", "left")
    name = F.coalesce("product_category", F.lit(marts.UNCATEGORIZED)).alias("product_category")
    categories = materialize(per_product.groupBy(name).agg(
        F.sum("items").alias("items"), money_total("revenue_cents").alias("revenue")), "takeaway-categories")
    top = top_n(categories, 10, c("revenue").desc(), c("product_category")).agg(F.sum("revenue")).scalar()
    whole = categories.agg(F.struct(F.sum("items").alias("items"), F.sum("revenue").alias("revenue"))).scalar()
    enough = (c("items") >= PRICE_CUTOFF_ITEMS) & (c("items") * PRICE_CUTOFF_SHARE >= whole["items"])
    price = ratio("revenue", "items")
    dearest = categories.filter(enough).agg(F.min(F.struct((-price).alias("price"), "product_category"))).scalar()
    sellers = pairs.groupBy("seller_id").agg(money_total("revenue_cents").alias("revenue"))
    leading = _top_decile(sellers, 1, 1).agg(F.max("share_pct")).scalar()
    frame = _of_states(cells).select("*", F.struct(top.alias("top"), whole["revenue"].alias("revenue")).alias("category"), dearest.alias("dearest"),
                                     leading.alias("sellers"))
    people = _of_people(m, cells).agg(F.struct(*[F.max(x).alias(x) for x in ("people", "repeat", "revenue")])).scalar()
    every = _of_all(cells)
    every = every.agg(F.struct(*[F.max(x).alias(x) for x in every.columns])).scalar()
    frame = frame.withColumns({"p": people, "e": every})

    def shown(share: Column) -> tuple:
        return share.cast("decimal(10,1)"), "%"

    def sentence(*parts: str | Column) -> Column:
        text = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
        return F.coalesce(text, F.lit(NOTHING))

    said = {
        "category share": ("Top 10 categories bring ", *shown(pct(c("category.top"), c("category.revenue"), 1)), " of revenue"),
        "price": ("Highest average price: ", c("dearest.product_category"), " (", -c("dearest.price"), ")"),
        "freight": ("Highest freight share: ", c("freight.state"), " (", c("freight.value"), "% of revenue)"),
        "late reviews": ("Late orders score ", c("e.late"), " against ", c("e.on_time"), " on time"),
        "slowest state": ("Slowest state with ", str(MIN_ORDERS), "+ orders: ", c("slowest.state"), " (", c("slowest.value"), " days)"),
        "seller share": ("Top 10% of sellers bring ", *shown(c("sellers")), " of revenue"),
        "repeat rate": (pct(c("p.repeat"), c("p.people")), "% of customers came back"),
        "repeat revenue": ("Repeat customers bring ", *shown(pct(c("p.revenue"), c("e.revenue"), 1)), " of revenue"),
        "top state": (c("most.state"), " has ", *shown(pct(c("most.value"), c("e.people"), 1)), " of customers"),
        "lowest rated": ("Lowest rated state: ", c("lowest.state"), " (", c("lowest.value"), ")"),
        "low scores": (c("e.low"), "% of the reviews of late orders are 1 or 2 stars"),
        "payment": ("Credit cards carry ", *shown(c("e.card")), " of payment value"),
    }
    rows = F.array(*[F.struct(F.lit(topic).alias("topic"), sentence(*parts).alias("sentence")) for topic, parts in said.items()])
    return frame.select(F.explode(rows).alias("row")).select("row.*")


MEASURES = {
    "m_core": core,
    "m_freight_pct": freight_pct,
    "m_avg_item_price": avg_item_price,
    "m_category_table": category_table,
    "m_freight_by_state": freight_by_state,
    "m_top10_category_share": top10_category_share,
    "m_top_price_category": top_price_category,
    "m_top_freight_state": top_freight_state,
    "m_ontime_pct": ontime_pct,
    "m_avg_delivery_days": avg_delivery_days,
    "m_late_orders": late_orders,
    "m_avg_days_late": avg_days_late,
    "m_active_sellers": active_sellers,
    "m_delivered_orders": delivered_orders,
    "m_review_by_status": review_by_status,
    "m_slowest_states": slowest_states,
    "m_delivery_histogram": delivery_histogram,
    "m_revenue_by_seller_state": revenue_by_seller_state,
    "m_top_decile_seller_share": top_decile_seller_share,
    "m_repeat_rate": repeat_rate,
    "m_orders_per_customer": orders_per_customer,
    "m_revenue_per_customer": revenue_per_customer,
    "m_customers_by_type": customers_by_type,
    "m_new_customers_month": new_customers_month,
    "m_customers_by_state": customers_by_state,
    "m_revenue_share_by_type": revenue_share_by_type,
    "m_state_customer_revenue_share": state_customer_revenue_share,
    "m_review_trend": review_trend,
    "m_lowest_rated_states": lowest_rated_states,
    "m_low_score_share": low_score_share,
    "m_low_score_by_status": low_score_by_status,
    "m_avg_review_score": avg_review_score,
    "m_review_count": review_count,
    "m_total_payment_value": total_payment_value,
    "m_cc_payments": cc_payments,
    "m_payment_mix": payment_mix,
    "m_avg_installments_cc": avg_installments_cc,
    "m_cc_installments": cc_installments,
    "m_payment_reconciliation": payment_reconciliation,
    "m_payment_reconciliation_by_order": reconciliation_by_order,
    "m_monthly_revenue": monthly_revenue,
    "m_top_categories_states": top_categories_states,
    "m_status_split": status_split,
    "m_review_distribution": review_distribution,
    "m_takeaways": takeaways,
}
