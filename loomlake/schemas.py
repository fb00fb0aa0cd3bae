"""Schemas of the tables."""

from __future__ import annotations

CHANGE_EVENT = "seq long, kind string, action string, did string, collection string, rkey string, cid string, body string, handle string, status string, live boolean, rev string, ts timestamp"
RECORDS = "uri string, cid string, did string, collection string, rkey string, json string, indexed_at timestamp, record_created_at timestamp"
ACTORS = "did string, handle string, indexed_at timestamp"
EXTERNAL_LABELS = "id long, subscription_url string, seq long, label_index int, src string, uri string, cid string, val string, neg boolean, cts timestamp, exp timestamp, sig string, ver int, raw_json string, received_at timestamp"
ACTIVITY = "id long, timestamp timestamp, operation string, collection string, did string, rkey string, status string, error_message string, event_json string"
LABELS = "id long, src string, uri string, cid string, val string, neg boolean, cts timestamp, exp timestamp"
LABEL_DEFINITIONS = "val string, description string, severity string, default_visibility string"
LABEL_PREFERENCES = "did string, label_val string, visibility string, ts timestamp"
REPORTS = "id long, reporter_did string, subject_uri string, reason_type string, reason string, status string, created_at timestamp"
EDGES = "issuer string, subject string"

# Fixed values.
SEVERITIES = ("inform", "alert", "takedown")
VISIBILITIES = ("ignore", "show", "warn", "hide")
REPORT_REASONS = ("spam", "violation", "misleading", "sexual", "rude", "other")
PURGING_STATUSES = ("deleted", "deactivated", "suspended", "takendown")
