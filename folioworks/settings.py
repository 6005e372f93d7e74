"""Limits and ages as plain values: every operator takes them as an argument, none reads a global."""

from __future__ import annotations

from dataclasses import dataclass

MIB = 1024 * 1024


@dataclass(frozen=True)
class ArchiveLimits:
    """Thresholds of the archive guard and the rules for entries."""

    max_entries: int = 500
    max_total_bytes: int = 500 * MIB
    max_ratio: float = 200.0
    max_depth: int = 1
    entry_exts: tuple[str, ...] = ("docx", "pdf")
    max_name_bytes: int = 255
    max_path_chars: int = 1024


@dataclass(frozen=True)
class UploadLimits:
    """What may be uploaded at the top level, and how it is split into parts."""

    max_bytes: int = 5 * 1024 * MIB
    part_bytes: int = 8 * MIB
    exts: tuple[str, ...] = ("docx", "pdf", "zip")


@dataclass(frozen=True)
class Ages:
    """Lifecycle limits: silence before takeover, waiting times of the sweeps, attempts allowed."""

    stale_seconds: int = 30
    reconcile_seconds: int = 30
    abandon_seconds: int = 3600
    max_attempts: int = 3


@dataclass(frozen=True)
class Retention:
    """Days an object may stay under each prefix; incomplete transfers expire on their own clock."""

    incoming_days: int = 1
    staging_days: int = 7
    incomplete_days: int = 1


ARCHIVE_LIMITS = ArchiveLimits()
UPLOAD_LIMITS = UploadLimits()
AGES = Ages()
RETENTION = Retention()
