"""Row shape of the JSON logs."""

from __future__ import annotations

LOG_LINE = (
    "ts string, level string, event string, logger string, pid int, file_id string, batch_id string, "
    "task_id string, attempt int, entry_index int, status string, reason string, countdown int, sweep string, "
    "file_ids array<string>, reset int, requeued int, errored int, cancelled int, enqueue_failed int")
