"""Parameters of the operators, as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass

from postloom import fixed


@dataclass(frozen=True)
class DigestOptions:
    """Switches and limits of the digest; 0 means "no limit" where a limit is meant."""

    max_message_excerpt: int = fixed.EXCERPT_LIMIT
    include_read_status: bool = True
    include_global_stats: bool = True
    include_account_stats: bool = True
    include_summaries: bool = True
    include_key_points: bool = True
    include_action_items: bool = True
    include_raw_excerpt_fallback: bool = True
    max_messages: int = 100
    max_key_points_per_message: int = 5
    max_action_items_per_message: int = 3
    priority_only: bool = False
    account_label: str = ""
    generator: str = "postloom"

    def __post_init__(self):
        for name in ("max_message_excerpt", "max_messages", "max_key_points_per_message",
                     "max_action_items_per_message"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")


@dataclass(frozen=True)
class TriageOptions:
    """What one triage pass does and which sinks it may touch."""

    fetch_unread_only: bool = False
    force_reprocess: bool = False
    dry_run: bool = False
    stateless: bool = False
    repair_attempts: int = 1
    custom_labels: tuple[str, ...] = ()
    channel: str = "file"
    digest: DigestOptions = DigestOptions()

    max_window_hours: float = fixed.MAX_WINDOW_HOURS
    system_prompt: str = ""

    def __post_init__(self):
        if self.repair_attempts not in (0, 1):
            raise ValueError("repair_attempts must be 0 or 1")

    @property
    def labels(self) -> tuple[str, ...]:
        return tuple(fixed.DEFAULT_LABELS) + tuple(self.custom_labels)
