"""Toy panels for hand-checked cases."""

from datetime import date, timedelta

from tidepanel.sources.schemas import DAILY, PAYMENT_METHODS

START = date(2024, 1, 1)


def day(i: int) -> date:
    return START + timedelta(days=i)


def panel(spark, rows, merchant="M1"):
    """rows: list of dicts overriding a quiet default day."""
    out = []
    for i, row in enumerate(rows):
        base = dict(
            merchant_id=row.get("merchant_id", merchant), date=day(row.get("day_index", i)), day_index=row.get("day_index", i), gmv=1000.0, transaction_count=10, aov=100.0,
            refund_count=0, refund_amount=0.0, refund_rate=0.0, chargeback_count=0, chargeback_amount=0.0, chargeback_rate=0.0,
            fulfillment_delay_avg_days=1.0, fulfillment_on_time_rate=0.9, customer_count=8, new_customers=2, returning_customers=6,
            new_customer_rate=0.25, liquidity_balance=5000.0, pending_settlement_amount=100.0,
            **{f"pct_pay_{m}": 0.2 for m in PAYMENT_METHODS},
        )
        base.update(row)
        out.append(tuple(base[f.name] for f in DAILY))
    return spark.createDataFrame(out, DAILY)


def column(df, name, order="day_index"):
    return [r[name] for r in df.orderBy(order).collect()]
