"""The nine table contracts: types, required columns, keys and references."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_STR, _INT, _TS = T.StringType(), T.IntegerType(), T.TimestampNTZType()
_MONEY = T.DecimalType(10, 2)
# Two integer digits would do for the known coordinates; three hold every longitude.
_DEGREES = T.DecimalType(11, 8)


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str


@dataclass(frozen=True)
class TableContract:
    name: str
    columns: tuple[tuple[str, T.DataType, bool], ...]
    key: tuple[str, ...] = ()
    references: tuple[ForeignKey, ...] = ()
    text_columns: tuple[str, ...] = ()
    renames: dict[str, str] = field(default_factory=dict)
    distinct_rows: bool = False

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in self.columns])

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(name for name, _, nullable in self.columns if not nullable)

    @property
    def raw_schema(self) -> T.StructType:
        """All columns as text under the raw header names; cleaning casts them."""
        raw = {new: old for old, new in self.renames.items()}
        return T.StructType([T.StructField(raw.get(n, n), _STR, True) for n, _, _ in self.columns])


def _columns(*specs: tuple[str, T.DataType] | tuple[str, T.DataType, bool]):
    """(name, type) is required; (name, type, True) may be null."""
    return tuple((s[0], s[1], len(s) == 3) for s in specs)


CONTRACTS: dict[str, TableContract] = {c.name: c for c in (
    TableContract(
        "customers",
        _columns(("customer_id", _STR), ("customer_unique_id", _STR),
                 ("customer_zip_code_prefix", _INT), ("customer_city", _STR), ("customer_state", _STR)),
        key=("customer_id",),
        text_columns=("customer_id", "customer_unique_id", "customer_city", "customer_state"),
    ),
    TableContract(
        "orders",
        _columns(("order_id", _STR), ("customer_id", _STR), ("order_status", _STR),
                 ("order_purchase_timestamp", _TS), ("order_approved_at", _TS, True),
                 ("order_delivered_carrier_date", _TS, True),
                 ("order_delivered_customer_date", _TS, True),
                 ("order_estimated_delivery_date", _TS, True)),
        key=("order_id",),
        references=(ForeignKey("customer_id", "customers", "customer_id"),),
        text_columns=("order_id", "customer_id", "order_status"),
    ),
    TableContract(
        "order_items",
        _columns(("order_id", _STR), ("order_item_id", _INT), ("product_id", _STR), ("seller_id", _STR),
                 ("shipping_limit_date", _TS), ("price", _MONEY), ("freight_value", _MONEY)),
        key=("order_id", "order_item_id"),
        references=(ForeignKey("order_id", "orders", "order_id"),
                    ForeignKey("product_id", "products", "product_id"),
                    ForeignKey("seller_id", "sellers", "seller_id")),
        text_columns=("order_id", "product_id", "seller_id"),
    ),
    TableContract(
        "payments",
        _columns(("order_id", _STR), ("payment_sequential", _INT), ("payment_type", _STR),
                 ("payment_installments", _INT), ("payment_value", _MONEY)),
        key=("order_id", "payment_sequential"),
        references=(ForeignKey("order_id", "orders", "order_id"),),
        text_columns=("order_id", "payment_type"),
    ),
    TableContract(
        "reviews",
        _columns(("review_id", _STR), ("order_id", _STR), ("review_score", _INT),
                 ("review_comment_title", _STR, True), ("review_comment_message", _STR, True),
                 ("review_creation_date", _TS), ("review_answer_timestamp", _TS, True)),
        key=("review_id", "order_id"),
        references=(ForeignKey("order_id", "orders", "order_id"),),
        text_columns=("review_id", "order_id"),
    ),
    TableContract(
        "products",
        _columns(("product_id", _STR), ("product_category_name", _STR, True),
                 ("product_name_length", _INT, True), ("product_description_length", _INT, True),
                 ("product_photos_qty", _INT, True), ("product_weight_g", _INT, True),
                 ("product_length_cm", _INT, True), ("product_height_cm", _INT, True),
                 ("product_width_cm", _INT, True)),
        key=("product_id",),
        text_columns=("product_id",),
        # The raw file misspells these two headers.
        renames={"product_name_lenght": "product_name_length",
                 "product_description_lenght": "product_description_length"},
    ),
    TableContract(
        "sellers",
        _columns(("seller_id", _STR), ("seller_zip_code_prefix", _INT), ("seller_city", _STR),
                 ("seller_state", _STR)),
        key=("seller_id",),
        text_columns=("seller_id", "seller_city", "seller_state"),
    ),
    TableContract(
        "geolocation",
        _columns(("geolocation_zip_code_prefix", _INT), ("geolocation_lat", _DEGREES),
                 ("geolocation_lng", _DEGREES), ("geolocation_city", _STR), ("geolocation_state", _STR)),
        text_columns=("geolocation_city", "geolocation_state"),
        distinct_rows=True,
    ),
    TableContract(
        "category_translation",
        _columns(("product_category_name", _STR), ("product_category_name_english", _STR)),
        key=("product_category_name",),
        text_columns=("product_category_name", "product_category_name_english"),
    ),
)}
