"""Column roles shared by every operator."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class HistorySpec:
    """Names the columns of an event history.

    ``tiebreak`` makes the order inside one entity total, so every window result
    is deterministic even when two events share a timestamp.
    """

    entity: str = "customer_id"
    time: str = "order_date"
    tiebreak: tuple[str, ...] = ("order_id",)
    state: str = "channel"
    positive: str = "DIGITAL"
    negative: str = "NO_DIGITAL"
    measures: Mapping[str, str] = field(
        default_factory=lambda: {
            "billed": "billed_usd",
            "items": "distinct_items",
            "boxes": "boxes",
        }
    )

    @property
    def order_columns(self) -> list[str]:
        return [self.time, *self.tiebreak]


ORDERS = HistorySpec()

EVENTS = HistorySpec(
    entity="user_id",
    time="ts",
    tiebreak=("event_id",),
    state="event_type",
    positive="purchase",
    negative="other",
    measures={"value": "value"},
)
