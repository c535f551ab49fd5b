"""Declared schemas, keys and references of the nine input tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str


@dataclass(frozen=True)
class TableSpec:
    """One input table: its columns in file order and the constraints declared on it."""

    ddl: str
    primary_key: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = field(default=())

    @property
    def required(self) -> tuple[str, ...]:
        """Columns that may not be NULL: those of the primary key, and those declared so."""
        return tuple(dict.fromkeys((*self.primary_key, *self.not_null)))

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


# Table and column names are those of the input files, spelling included.
TABLE_SPECS: dict[str, TableSpec] = {
    "customers": TableSpec(
        ddl="""customer_id string, customer_unique_id string, customer_zip_code_prefix int,
            customer_city string, customer_state string""",
        primary_key=("customer_id",),
        not_null=("customer_unique_id",),
    ),
    "sellers": TableSpec(
        ddl="seller_id string, seller_zip_code_prefix int, seller_city string, seller_state string",
        primary_key=("seller_id",),
    ),
    "products": TableSpec(
        ddl="""product_id string, product_category_name string, product_name_lenght int,
            product_description_lenght int, product_photos_qty int, product_weight_g decimal(18,4),
            product_length_cm decimal(18,4), product_height_cm decimal(18,4),
            product_width_cm decimal(18,4)""",
        primary_key=("product_id",),
    ),
    "product_category_name_translation": TableSpec(
        ddl="product_category_name string, product_category_name_english string",
        primary_key=("product_category_name",),
    ),
    "orders": TableSpec(
        ddl="""order_id string, customer_id string, order_status string,
            order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz,
            order_delivered_carrier_date timestamp_ntz, order_delivered_customer_date timestamp_ntz,
            order_estimated_delivery_date timestamp_ntz""",
        primary_key=("order_id",),
        not_null=("customer_id",),
        foreign_keys=(ForeignKey("customer_id", "customers", "customer_id"),),
    ),
    "order_items": TableSpec(
        ddl="""order_id string, order_item_id int, product_id string, seller_id string,
            shipping_limit_date timestamp_ntz, price decimal(12,2), freight_value decimal(12,2)""",
        primary_key=("order_id", "order_item_id"),
        not_null=("order_id", "order_item_id", "product_id", "seller_id"),
        foreign_keys=(
            ForeignKey("order_id", "orders", "order_id"),
            ForeignKey("product_id", "products", "product_id"),
            ForeignKey("seller_id", "sellers", "seller_id"),
        ),
    ),
    "order_payments": TableSpec(
        ddl="""order_id string, payment_sequential int, payment_type string,
            payment_installments int, payment_value decimal(12,2)""",
        primary_key=("order_id", "payment_sequential"),
        not_null=("order_id", "payment_sequential"),
        foreign_keys=(ForeignKey("order_id", "orders", "order_id"),),
    ),
    "order_reviews": TableSpec(
        ddl="""review_id string, order_id string, review_score int, review_comment_title string,
            review_comment_message string, review_creation_date timestamp_ntz,
            review_answer_timestamp timestamp_ntz""",
        not_null=("order_id",),
        foreign_keys=(ForeignKey("order_id", "orders", "order_id"),),
    ),
    "geolocation": TableSpec(
        ddl="""geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double,
            geolocation_city string, geolocation_state string""",
    ),
}
