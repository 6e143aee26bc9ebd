"""Declared schemas of the stored tables."""

from __future__ import annotations

MESSAGES = (
    "run_id string, account_label string, uid bigint, folder string, subject string, "
    "from_addr string, to_addr string, internal_date timestamp_ntz, date timestamp_ntz, "
    "is_read boolean, body string, "
    "attachments array<struct<filename:string,mime_type:string,size:bigint>>"
)

# The runs ledger is a log: one row per state change, the highest version is the current state.
RUNS = (
    "id string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, "
    "message_count bigint, error string, version bigint"
)
PROCESSED_MESSAGES = (
    "run_id string, account_label string, uid bigint, is_read boolean, classification string, "
    "digest_excerpt string, processed_at timestamp_ntz"
)
FLAGS_APPLIED = "account_label string, uid bigint, flag string, applied_at timestamp_ntz"
DIGESTS = "run_id string, channel string, status string, payload_hash string"
SUMMARIES = (
    "run_id string, finished_at timestamp_ntz, accounts_failed bigint, high_priority_count bigint, "
    "snapshot_id string, seq bigint"
)
LABEL_COUNTS = "run_id string, label string, n bigint, snapshot_id string"
SENDER_COUNTS = "run_id string, sender string, n bigint, snapshot_id string"
DOMAIN_COUNTS = "run_id string, domain string, n bigint, snapshot_id string"

LEDGER = {
    "runs": RUNS,
    "processed_messages": PROCESSED_MESSAGES,
    "flags_applied": FLAGS_APPLIED,
    "digests": DIGESTS,
    "run_digest_summaries": SUMMARIES,
    "run_digest_label_counts": LABEL_COUNTS,
    "run_digest_sender_counts": SENDER_COUNTS,
    "run_digest_domain_counts": DOMAIN_COUNTS,
}
