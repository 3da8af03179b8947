"""Settings of the streaming job."""

from __future__ import annotations

from dataclasses import dataclass, field

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def seconds(text: str) -> int:
    """``"10 minutes"`` as 600: a number and a unit."""
    parts = text.strip().split()
    unit = parts[1].lower().rstrip("s") if len(parts) == 2 else ""
    if not parts or not parts[0].isdigit() or unit not in _UNITS:
        raise ValueError(f"not a duration: {text!r}")
    return int(parts[0]) * _UNITS[unit]


@dataclass(frozen=True)
class StreamConfig:
    checkpoint_root: str
    output_root: str
    watermark: str = "10 minutes"
    window: str = "5 minutes"
    slide: str | None = None
    on_time_seconds: int = 60
    accept_seconds: int = 600
    trigger: str = "30 seconds"
    max_retries: int = 3
    backoff_seconds: float = 1.0
    tenants: tuple[str, ...] = ()
    kafka_servers: str = ""
    dlq_topic: str = "dead-letters.events"
    compact_every: int = 20
    topics: tuple[str, ...] = ("orders.events", "payments.events", "users.events", "products.events", "system.events")
    starting_offsets: str = "latest"
    max_offsets_per_trigger: int | None = None
    options: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not 0 <= self.on_time_seconds <= self.accept_seconds:
            raise ValueError("on_time_seconds must be at most accept_seconds")
        if self.accept_seconds > seconds(self.watermark):
            raise ValueError("records are accepted for longer than the watermark keeps state")
        if self.slide and seconds(self.slide) > seconds(self.window):
            raise ValueError("a slide longer than the window leaves gaps")
        if self.max_retries < 0 or self.backoff_seconds < 0:
            raise ValueError("retries and backoff can't be negative")
        if self.compact_every < 1:
            raise ValueError("changes are compacted after one batch at the earliest")
        seconds(self.trigger)

    def checkpoint(self, query: str) -> str:
        return f"{self.checkpoint_root}/{query}"
