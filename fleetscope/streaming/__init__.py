"""Streaming alerts. Each takes a streaming or a static DataFrame and gives the same rows for both."""

from .alerts import contention_windows, failed_login_windows, held_contention_windows, wait_class_windows, waits_with_holder
from .run import run_available, top_events_each_batch

__all__ = ["contention_windows", "failed_login_windows", "held_contention_windows", "wait_class_windows", "waits_with_holder", "run_available", "top_events_each_batch"]
