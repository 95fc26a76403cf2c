"""Fixed vocabularies and table schemas of the change feed."""

from __future__ import annotations

# They must agree with every producer and consumer of the feed.
EVENT_VERSION = 1
PARTITIONS = ("content", "commerce", "system")
PUBLIC_STATUSES = ("publish",)
POST_TYPES = ("post", "page")
ZERO_DATE = "0000-00-00 00:00:00"
SQL_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})$"
RETRY_LIMIT = 10
BACKOFF_BASE_SECONDS = 30
BACKOFF_CAP_SECONDS = 3600
JITTER_SHARE = 0.25
PAGE_LIMITS = {"page": (20, 100), "post": (20, 100), "category": (50, 200)}
QUEUE_LAG_TARGET_SECONDS = 60
SYNC_DELAY_TARGET_SECONDS = 30
# End of fixed values.

FAILURES = ("rejected", "orphan", "unregistered", "unhandled")


def _fields(text: str) -> str:
    return ", ".join(line.strip() for line in text.strip().splitlines())


ENVELOPE = _fields("""
    id string
    event_type string
    event_version int
    aggregate_type string
    aggregate_id string
    aggregate_version bigint
    source_updated_at timestamp
    checksum string
    correlation_id string
    causation_id string
    payload string
    created_at timestamp
""")
OUTBOX = ENVELOPE + ", status string, relayed_at timestamp"
LEDGER = "event_id string, checksum string, processed_at timestamp"
VERSIONS = _fields("""
    aggregate_type string
    aggregate_id string
    latest_processed_version bigint
    latest_processed_at timestamp
""")
BRIDGE = "entity_id string, taxonomy_id string"
POSTS = _fields("""
    id string
    source_post_id bigint
    source_entity_type string
    slug string
    title string
    content string
    excerpt string
    status string
    author string
    published_at timestamp
    updated_at timestamp
    deleted_at timestamp
    checksum string
    meta_jsonb string
    created_at timestamp
    synced_at timestamp
""")
PAGES = _fields("""
    id string
    source_post_id bigint
    source_entity_type string
    slug string
    title string
    content string
    status string
    parent_id bigint
    menu_order int
    published_at timestamp
    updated_at timestamp
    deleted_at timestamp
    checksum string
    meta_jsonb string
    created_at timestamp
    synced_at timestamp
""")
TAXONOMIES = _fields("""
    id string
    source_term_id bigint
    taxonomy_type string
    slug string
    name string
    description string
    parent_id bigint
    post_count int
    deleted_at timestamp
    checksum string
    created_at timestamp
    updated_at timestamp
    synced_at timestamp
""")
ATTEMPTS = _fields("""
    event_id string
    queue_name string
    attempts int
    available_at timestamp
    deadline timestamp
    last_error string
""")
DEAD_LETTERS = _fields("""
    id string
    event_id string
    failure_reason string
    attempt_count int
    payload_snapshot string
    created_at timestamp
""")


def columns(ddl: str) -> list[str]:
    """Column names of one of the schemas above."""
    return [part.split()[0] for part in ddl.split(", ")]
