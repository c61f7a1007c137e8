"""orderpath: channel-transition features, profiling and models over order histories."""

from orderpath.spec import HistorySpec

__all__ = ["HistorySpec"]
