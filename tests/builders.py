"""Small hand-made warehouses."""

from __future__ import annotations

import datetime
from decimal import Decimal

from orderlens.contracts import CONTRACTS
from orderlens.warehouse import Warehouse

T0 = datetime.datetime(2020, 1, 10, 12)

_DEFAULTS = {
    "customers": {"customer_zip_code_prefix": 1, "customer_city": "town", "customer_state": "AA"},
    "orders": {"customer_id": "c1", "order_status": "delivered", "order_purchase_timestamp": T0,
               "order_approved_at": None, "order_delivered_carrier_date": None,
               "order_delivered_customer_date": None, "order_estimated_delivery_date": None},
    "order_items": {"order_item_id": 1, "product_id": "p1", "seller_id": "s1", "shipping_limit_date": T0,
                    "price": "10.00", "freight_value": "1.00"},
    "payments": {"payment_sequential": 1, "payment_type": "credit_card", "payment_installments": 1,
                 "payment_value": "11.00"},
    "reviews": {"review_score": 5, "review_comment_title": None, "review_comment_message": None,
                "review_creation_date": T0, "review_answer_timestamp": None},
    "products": {n: None for n, _, _ in CONTRACTS["products"].columns},
    "sellers": {"seller_zip_code_prefix": 1, "seller_city": "town", "seller_state": "AA"},
    "geolocation": {},
    "category_translation": {},
}


def build(spark, **tables: list[dict]) -> Warehouse:
    """Rows by table; left-out columns take plain defaults, left-out tables are empty."""
    frames = {}
    for name, contract in CONTRACTS.items():
        rows = []
        for given in tables.get(name, []):
            row = {**_DEFAULTS[name], **given}
            if name == "customers":
                row.setdefault("customer_unique_id", row["customer_id"])
            rows.append(tuple(
                Decimal(row[c]) if isinstance(row[c], str) and kind.typeName() == "decimal" else row[c]
                for c, kind, _ in contract.columns))
        frames[name] = spark.createDataFrame(rows, contract.schema)
    return Warehouse.of(spark, **frames)


def rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def one(df) -> dict:
    found = rows(df)
    assert len(found) == 1
    return found[0]
