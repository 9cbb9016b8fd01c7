"""Fixed schemas of tables, events and payloads."""

from __future__ import annotations

ORDERS = (
    "order_id long, shard_id int, status string, x int, y int, attempt int, cancel_reason string, retry_reason string, "
    "miss_reason string, rider_id long, score int, last_event_id string, updated_at long"
)
RIDERS = "uid long, x int, y int, online boolean, cell_id long, count long"
EVENT = "event_id string, event_type string, aggregate_type string, aggregate_id string, shard_id int, occurred_at long, payload string"
EVENT_LOG = f"shard_id int, offset_value long, {EVENT.replace('shard_id int, ', '')}"

# Event types and topics.
ORDER_CREATED, ORDER_CANCELLED, ORDER_RETRY = "order_created", "order_cancelled", "order_retry_request"
ORDER_MATCHED, ORDER_MISSED, MATCH_REQUESTED = "order_matched", "order_missed", "match_requested"
ORDER_EVENTS, RIDER_EVENTS, MATCH_REQUESTS = "order-events", "rider-events", "match-requests"

#: Payload of each event type; JSON keys as the envelopes have them.
PAYLOADS = {
    ORDER_CREATED: "OrderID long, X int, Y int",
    ORDER_CANCELLED: "OrderID long, Reason string",
    ORDER_MATCHED: "OrderID long, RiderID long, Score int",
    ORDER_MISSED: "OrderID long, Reason string",
    ORDER_RETRY: "OrderID long, Attempt int, Reason string",
    MATCH_REQUESTED: "OrderID long, X int, Y int, Attempt int",
}
ENVELOPE = "ID string, Type string, AggregateType string, AggregateID string, ShardID int, OccurredAt long, Payload string"
