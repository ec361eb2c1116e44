"""The nine contract tables as one value that every analysis takes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.contracts import CONTRACTS


class Warehouse:
    """Tables by contract name. Each is opened when it is first asked for."""

    def __init__(self, spark: SparkSession, load: Callable[[str], DataFrame]):
        self.spark = spark
        self._load = load
        self._tables: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, **tables: DataFrame) -> Warehouse:
        return cls(spark, tables.__getitem__)

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._load(name)
        return self._tables[name]

    def collated(self, collation: str) -> Warehouse:
        """The same tables with their text under a collation, ``UNICODE_CI_AI`` for one that ignores case and accents.
        Filters, joins and groups on text then follow it in every analysis; folders of a stored layout keep plain text."""
        def load(name: str) -> DataFrame:
            df = self.table(name)
            return df.select([F.collate(F.col(f.name), collation).alias(f.name) if isinstance(f.dataType, T.StringType)
                              else F.col(f.name) for f in df.schema.fields])
        return Warehouse(self.spark, load)

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in CONTRACTS}

    @property
    def customers(self) -> DataFrame:
        return self.table("customers")

    @property
    def orders(self) -> DataFrame:
        return self.table("orders")

    @property
    def order_items(self) -> DataFrame:
        return self.table("order_items")

    @property
    def payments(self) -> DataFrame:
        return self.table("payments")

    @property
    def reviews(self) -> DataFrame:
        return self.table("reviews")

    @property
    def products(self) -> DataFrame:
        return self.table("products")

    @property
    def sellers(self) -> DataFrame:
        return self.table("sellers")

    @property
    def geolocation(self) -> DataFrame:
        return self.table("geolocation")

    @property
    def category_translation(self) -> DataFrame:
        return self.table("category_translation")
