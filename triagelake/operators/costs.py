"""Model prices, call costs, budgets and retention."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.sinks.exports import add_to_set

# Fixed values: (provider, model, USD per 1000 input tokens, USD per 1000 output tokens).
PRICES = [
    ("openai", "gpt-4o", 0.0025, 0.010),
    ("openai", "gpt-4o-mini", 0.00015, 0.0006),
    ("openai", "gpt-4-turbo", 0.010, 0.030),
    ("openai", "gpt-4", 0.030, 0.060),
    ("anthropic", "claude-3-5-sonnet-20241022", 0.003, 0.015),
    ("anthropic", "claude-3-opus-20240229", 0.015, 0.075),
    ("anthropic", "claude-3-sonnet-20240229", 0.003, 0.015),
    ("anthropic", "claude-3-haiku-20240307", 0.00025, 0.00125),
    ("google", "gemini-1.5-pro", 0.00125, 0.005),
    ("google", "gemini-1.5-flash", 0.000075, 0.0003),
    ("google", "gemini-pro", 0.0005, 0.0015),
]
DEFAULT_MODEL = {"openai": "gpt-4o", "anthropic": "claude-3-5-sonnet-20241022", "google": "gemini-1.5-pro"}
MONTHLY_BUDGET_USD = 1000.0
RETENTION_DAYS = 90

_MEASURES = ["input_tokens", "output_tokens", "requests"]


Price = tuple[str, str, float, float]


def attach_prices(calls: DataFrame, prices: list[Price] = PRICES) -> DataFrame:
    """Price per call; a model not listed takes its provider's default, an unknown provider none.

    The list is a few literals, looked up in a map inside the projection: no join, so calls
    of the two or three providers there are never meet in two or three tasks.
    """

    def lookup(entries: dict[str, tuple[float, float]], key: Column) -> Column:
        pairs = [
            x
            for name, (cost_in, cost_out) in entries.items()
            for x in (F.lit(name), F.struct(F.lit(cost_in).alias("price_in"), F.lit(cost_out).alias("price_out")))
        ]
        return F.try_element_at(F.create_map(*pairs), key)

    listed = {f"{p}/{m}": (i, o) for p, m, i, o in prices}
    defaults = {p: listed[f"{p}/{m}"] for p, m in DEFAULT_MODEL.items() if f"{p}/{m}" in listed}
    price = F.coalesce(
        lookup(listed, F.concat_ws("/", "provider", "model")), lookup(defaults, F.col("provider"))
    )
    priced = calls.withColumn("__price", price)
    return priced.withColumns(
        {
            "price_in": F.col("__price.price_in"),
            "price_out": F.col("__price.price_out"),
            "priced": F.col("__price").isNotNull(),
        }
    ).drop("__price")


def call_cost(input_tokens: Column, output_tokens: Column, price_in: Column, price_out: Column) -> Column:
    return input_tokens * price_in / 1000 + output_tokens * price_out / 1000


def with_cost(calls: DataFrame, prices: list[Price] = PRICES) -> DataFrame:
    """Cost entries: calls with ``cost_usd``."""
    priced = attach_prices(calls, prices)
    return priced.withColumn(
        "cost_usd",
        call_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("price_in"), F.col("price_out")),
    ).drop("price_in", "price_out", "priced")


def distinct_entries(entries: DataFrame) -> DataFrame:
    """An identical entry counts once."""
    return entries.dropDuplicates()


def in_range(
    entries: DataFrame, start: datetime | None = None, end: datetime | None = None, provider: str | None = None,
    now: datetime | None = None,
) -> DataFrame:
    """Entries from ``start`` (default: first of the month of ``now``) to ``end`` (default ``now``).

    Of entries stored by :func:`write_costs` only the folders of these months are read.
    """
    now = now or datetime.now(UTC).replace(tzinfo=None)
    start = start or datetime(now.year, now.month, 1)
    end = end or now
    rows = entries.where((F.col("timestamp") >= F.lit(start)) & (F.col("timestamp") <= F.lit(end)))
    if "month" in entries.columns:
        rows = rows.where(F.col("month").between(start.strftime("%Y-%m"), end.strftime("%Y-%m")))
    return rows if provider is None else rows.where(F.col("provider") == provider)


def token_totals(calls: DataFrame, keys: list) -> DataFrame:
    """Tokens and requests per key and model, summed as integers.

    Cost is linear in tokens, so prices are multiplied once per model after the sums:
    no price join and no floating-point sum over the raw rows.
    """
    names = list(dict.fromkeys([*keys, "provider", "model"]))
    return calls.groupBy(*names).agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.count("*").alias("requests"),
    )


def cost_by(calls: DataFrame, keys: list[str], prices: list[Price] = PRICES) -> DataFrame:
    """Cost, tokens and requests per ``keys`` (none: one row, cost 0.0 when empty)."""
    priced = with_cost(token_totals(calls, keys), prices)
    return priced.groupBy(*keys).agg(
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
        F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"),
    )


def breakdown(calls: DataFrame, prices: list[Price] = PRICES) -> DataFrame:
    """Total, per provider and per model rows from one aggregation of the calls."""
    priced = with_cost(token_totals(calls, []), prices)
    sets = priced.groupingSets([[], ["provider"], ["model"]], "provider", "model")
    return sets.agg(
        F.grouping_id().alias("g"),
        F.sum("cost_usd").alias("cost_usd"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
        F.sum("requests").alias("requests"),
    ).select(
        F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "provider").otherwise("model").alias("scope"),
        F.coalesce("provider", "model", F.lit("all")).alias("name"),
        "cost_usd",
        "tokens",
        "requests",
    )


def month_of(ts: Column) -> Column:
    """Month bucket ``YYYY-MM``."""
    return F.date_format(ts, "yyyy-MM")


def month_bounds(ts: Column) -> tuple[Column, Column]:
    """First instant of the month and of the next one (half-open)."""
    start = F.date_trunc("month", ts)
    return start, F.add_months(start, 1).cast("timestamp")


def monthly_cost(calls: DataFrame, prices: list[Price] = PRICES) -> DataFrame:
    return cost_by(calls.withColumn("month", month_of(F.col("timestamp"))), ["month"], prices)


def budget_check(monthly: DataFrame, limit: float = MONTHLY_BUDGET_USD) -> DataFrame:
    return monthly.select(
        "month",
        "cost_usd",
        F.lit(float(limit)).alias("budget_usd"),
        (F.col("cost_usd") <= F.lit(float(limit))).alias("within_budget"),
    )


def retained(entries: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Entries of months whose newest entry is not older than the retention period.

    Retention renews with each write to a month, so a month lives ``days`` past its last entry.
    The expired months are broadcast: there are at most twelve a year, whatever the entries.
    """
    months = entries.groupBy(month_of(F.col("timestamp")).alias("__month")).agg(F.max("timestamp").alias("__last"))
    expired = months.where(F.col("__last") + F.make_dt_interval(F.lit(days)) < now).select("__month")
    return entries.join(F.broadcast(expired), month_of(F.col("timestamp")) == F.col("__month"), "left_anti")


def write_costs(entries: DataFrame, path: str) -> None:
    """Add entries to the stored set, one folder per month so that range queries prune; an entry already stored is not stored again."""
    add_to_set(entries.withColumn("month", month_of(F.col("timestamp"))), path, "month")
