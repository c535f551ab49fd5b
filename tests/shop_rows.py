"""Short rows of the shop tables and readers of results, shared by the tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def month(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(f"{text}-01")


def money(text: str) -> Decimal:
    return Decimal(text)


def order(
    order_id: str,
    customer_id: str,
    bought: str | None = "2020-01-10",
    status: str | None = "delivered",
    arrived: str | None = None,
    promised: str | None = None,
) -> dict:
    return {
        "order_id": order_id,
        "customer_id": customer_id,
        "order_status": status,
        "order_purchase_timestamp": bought and ts(bought),
        "order_delivered_customer_date": arrived and ts(arrived),
        "order_estimated_delivery_date": promised and ts(promised),
    }


def customer(customer_id: str, person: str | None = None, state: str | None = None) -> dict:
    return {"customer_id": customer_id, "customer_unique_id": person, "customer_state": state}


def item(order_id: str, price: str, freight: str = "0.00", number: int = 1, product: str = "p") -> dict:
    return {
        "order_id": order_id,
        "order_item_id": number,
        "product_id": product,
        "seller_id": "s",
        "price": money(price),
        "freight_value": money(freight),
    }


def review(order_id: str, score: int | None) -> dict:
    return {"review_id": f"r-{order_id}", "order_id": order_id, "review_score": score}


def product(product_id: str, category: str | None) -> dict:
    return {"product_id": product_id, "product_category_name": category}


def translation(source: str, english: str) -> dict:
    return {"product_category_name": source, "product_category_name_english": english}


def as_dicts(df) -> list[dict]:
    return [row.asDict() for row in df.collect()]


def only(df) -> dict:
    rows = as_dicts(df)
    assert len(rows) == 1
    return rows[0]
