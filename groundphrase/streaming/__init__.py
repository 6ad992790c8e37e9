"""Rules on arriving patches."""

from groundphrase.streaming.arrivals import apply_to_arrivals

__all__ = ["apply_to_arrivals"]
