"""Features carried through a stream of periods; the SQL is that of the plain batch."""

from __future__ import annotations

from hindcast.plans.bindings import EVENTS, HOUR, HOURLY, NUDGE, events, hourly_events, rounded
from hindcast.plans.feature_queries import _amount_sql, _frame
from hindcast.plans.registry import query
from hindcast.roles import EntityFeatures
from hindcast.session import shared_path
from hindcast.streaming.live import LiveFeatures, replay


def _history_sql(name: str) -> str:
    return f"""CASE WHEN {name} IS NOT NULL THEN count(*) {_frame(name, None)} END AS history_{name}_count,
      t - max(t) {_frame(name, None)} AS recency_{name}"""


def _new_sql(name: str) -> str:
    c = f"history_{name}_count"
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_new_{name}"


@query(
    "r1_live_history",
    f"""WITH {HOURLY}, w AS (SELECT txn_id, {_history_sql('device')} FROM txn)
        SELECT txn_id, recency_device, history_device_count, {_new_sql('device')} FROM w""",
)
def _(spark, folder):
    spec = EntityFeatures("device", ("device",), recency=True, history=True)
    return replay(hourly_events(spark, folder), LiveFeatures(spec, shared_path(spark, "live")), 3)


INNER, OUTER = _amount_sql("card", "card", {"24h": 24 * HOUR})


@query(
    "r2_replay",
    f"""WITH {EVENTS}, w AS (SELECT txn_id, amount, {', '.join(INNER)}, count(*) {_frame('card', 24 * HOUR)} AS velocity_card_24h,
          {_history_sql('card')} FROM txn)
        SELECT txn_id, velocity_card_24h, {', '.join(OUTER)}, recency_card, history_card_count, {_new_sql('card')} FROM w""",
)
def _(spark, folder):
    window = {"24h": 24 * HOUR}
    spec = EntityFeatures("card", ("card",), window, window, recency=True, history=True)
    return rounded(replay(events(spark, folder), LiveFeatures(spec, shared_path(spark, "live")), 4), nudge=NUDGE)
