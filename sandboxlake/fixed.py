"""Fixed values.

Everything in this file is a fixed value (status names, legal moves, patterns, limits, statement
formats) that results have to agree on.  Nothing here is logic.
"""

# Request statuses.
PENDING_REVIEW = "PENDING_REVIEW"
PROVISIONING = "PROVISIONING"
ACTIVE = "ACTIVE"
EXPIRING_SOON = "EXPIRING_SOON"
EXPIRED = "EXPIRED"
CLEANUP_IN_PROGRESS = "CLEANUP_IN_PROGRESS"
CLEANED_UP = "CLEANED_UP"
FAILED = "FAILED"

# Object statuses (FAILED is shared).
PROVISIONED = "PROVISIONED"
REFRESH_PENDING = "REFRESH_PENDING"
DROPPED = "DROPPED"

# Statuses in which a request may be refreshed or modified, and those that count as open.
LIVE_STATUSES = (ACTIVE, EXPIRING_SOON)
OPEN_STATUSES = (PENDING_REVIEW, PROVISIONING, ACTIVE, EXPIRING_SOON)

# Legal request moves (current, target).
REQUEST_MOVES = (
    (PENDING_REVIEW, PROVISIONING),
    (PENDING_REVIEW, FAILED),
    (PROVISIONING, ACTIVE),
    (PROVISIONING, FAILED),
    (ACTIVE, EXPIRING_SOON),
    (ACTIVE, EXPIRED),
    (ACTIVE, CLEANUP_IN_PROGRESS),
    (ACTIVE, FAILED),
    (EXPIRING_SOON, EXPIRED),
    (EXPIRING_SOON, CLEANUP_IN_PROGRESS),
    (EXPIRING_SOON, ACTIVE),
    (EXPIRED, CLEANUP_IN_PROGRESS),
    (CLEANUP_IN_PROGRESS, CLEANED_UP),
    (CLEANUP_IN_PROGRESS, CLEANUP_IN_PROGRESS),
)

# Legal object moves (current, target).
OBJECT_MOVES = (
    (PROVISIONED, REFRESH_PENDING),
    (PROVISIONED, FAILED),
    (PROVISIONED, DROPPED),
    (REFRESH_PENDING, PROVISIONED),
    (REFRESH_PENDING, FAILED),
    (FAILED, PROVISIONED),
    (FAILED, REFRESH_PENDING),
    (FAILED, DROPPED),
)

# Clone strategies and refresh modes.
STRATEGIES = ("shallow_clone", "deep_clone", "view", "schema_only")
COPYING_STRATEGIES = ("shallow_clone", "deep_clone")
REFRESH_MODES = ("full", "incremental", "selective")

# Access modes and run results.
READ_ONLY, WRITE_ONLY, READ_WRITE = "READ_ONLY", "WRITE_ONLY", "READ_WRITE"
SUCCESS, PARTIAL_SUCCESS = "SUCCESS", "PARTIAL_SUCCESS"

# Config statuses.
CONFIG_SCANNED, CONFIG_PROVISIONED = "scanned", "provisioned"
CONFIG_VALID, CONFIG_INVALID = "valid", "invalid"

# Audit actions of the approval flow.
EDIT_PENDING = "CONFIG_EDIT_PENDING"
EDIT_APPROVED = "CONFIG_EDIT_APPROVED"
EDIT_REJECTED = "CONFIG_EDIT_REJECTED"
EDIT_ACTIONS = (EDIT_PENDING, EDIT_APPROVED, EDIT_REJECTED)

# Config fields whose edit on a provisioned request needs an approval.
SENSITIVE_FIELDS = ("access.developers", "access.qa_users", "additional_objects")

# Patterns.
NAME_PART = r"^[a-zA-Z0-9_]+$"
TWO_PART_NAME = r"^[a-zA-Z0-9_]+\.[a-zA-Z0-9_]+$"
THREE_PART_NAME = r"^[a-zA-Z0-9_]+\.[a-zA-Z0-9_]+\.[a-zA-Z0-9_]+$"
CATALOG_NAME = r"^[A-Za-z_][A-Za-z0-9_]*$"
PRINCIPAL = r"^[a-zA-Z0-9_.@\-]+$"
EMAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"
LEGACY_ID = r"^DR-[0-9]+$"
GENERATED_ID = r"^[A-Za-z][A-Za-z0-9]{0,7}[0-9]{3,12}$"

# Limits and defaults.
LINEAGE_ROW_LIMIT = 10_000
BYTES_PER_GB = 1_073_741_824
MAX_DURATION_DAYS = 90
NOTICE_DAYS = 7
AUDIT_RETENTION_DAYS = 365
AUDIT_LIST_LIMIT = 500
STATUS_CARD_AUDITS = 5
STREAM_SEARCH_LIMIT = 20
MAX_PARALLEL_COPIES = 10
DOCUMENT_VERSION = "1.0"

# Statement formats (schema name, principal).
GRANT_USAGE = "GRANT USAGE ON SCHEMA %s TO `%s`"
GRANT_READ_WRITE = "GRANT SELECT, MODIFY ON SCHEMA %s TO `%s`"
REVOKE_ALL = "REVOKE ALL PRIVILEGES ON SCHEMA %s FROM `%s`"
