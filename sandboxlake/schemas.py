"""Schemas of the state tables and of the nested documents, as DDL text."""

from __future__ import annotations


def fields(flat_schema: str) -> list[tuple[str, str]]:
    """(name, type) of the columns of one of the flat schemas below."""
    return [tuple(field.split(maxsplit=1)) for field in flat_schema.split(",")]


def columns(flat_schema: str) -> list[str]:
    return [name for name, _ in fields(flat_schema)]


REQUESTS = (
    "dr_id string, description string, status string, config_json string, created_at timestamp_ntz, "
    "created_by string, expiration_date date, last_refreshed_at timestamp_ntz, "
    "last_modified_at timestamp_ntz, notification_sent_at timestamp_ntz"
)

OBJECTS = (
    "dr_id string, source_fqn string, target_fqn string, target_environment string, object_type string, "
    "access_mode string, clone_strategy string, clone_revision_mode string, clone_revision_value string, "
    "provisioned_at timestamp_ntz, last_refreshed_at timestamp_ntz, status string, estimated_size_gb double"
)

ACCESS = (
    "dr_id string, user_email string, environment string, access_level string, granted_at timestamp_ntz"
)

AUDIT = (
    "log_id string, dr_id string, action string, action_detail string, performed_by string, "
    "performed_at timestamp_ntz, status string, error_message string"
)

CONFIGS = (
    "dr_id string, config_json string, status string, validation_errors string, created_at string, "
    "created_by string, updated_at string, expiration_date string, description string, "
    "manifest_json string, scanned_at string"
)

COUNTERS = "prefix string, last_value bigint, updated_at timestamp_ntz"

NOTICES = (
    "dr_id string, expiration_date date, status string, attempts bigint, leased_until timestamp_ntz, "
    "sent_at timestamp_ntz, error string"
)

EDGES = (
    "source_table_full_name string, target_table_full_name string, source_type string, "
    "target_type string, entity_id string, edge_seq bigint"
)

OUTCOMES = (
    "run_id string, task_no bigint, dr_id string, target_environment string, source_fqn string, "
    "target_fqn string, strategy string, action string, success boolean, error string"
)

# Keys of the current row in each state table.
STATE_KEYS = {
    "requests": ["dr_id"],
    "objects": ["dr_id", "source_fqn", "target_environment"],
    "access": ["dr_id", "user_email", "environment"],
    "audit": ["log_id"],
    "configs": ["dr_id"],
    "counters": ["prefix"],
    "notices": ["dr_id"],
}

STATE_SCHEMAS = {
    "requests": REQUESTS,
    "objects": OBJECTS,
    "access": ACCESS,
    "audit": AUDIT,
    "configs": CONFIGS,
    "counters": COUNTERS,
    "notices": NOTICES,
}

# The flat config form as stored in configs.config_json.
CONFIG_FORM = (
    "dr_id string, description string, streams array<string>, additional_objects array<string>, "
    "target_catalog string, qa_enabled boolean, data_revision_mode string, data_revision_version bigint, "
    "data_revision_timestamp string, developers array<string>, qa_users array<string>, "
    "expiration_date string, notification_days_before int, notification_recipients array<string>"
)

_REQUEST_BODY = (
    "dr_id: string, description: string, streams: array<struct<name: string>>, "
    "additional_objects: array<string>, "
    "environments: struct<dev: struct<enabled: boolean>, qa: struct<enabled: boolean>>, "
    "data_revision: struct<mode: string, version: bigint, timestamp: string>, "
    "access: struct<developers: array<string>, qa_users: array<string>>, "
    "lifecycle: struct<expiration_date: string, notification_days_before: int, "
    "notification_recipients: array<string>>"
)

# One request document; a text that does not parse lands whole in the last column.
REQUEST_DOCUMENT = (
    f"version string, development_request struct<{_REQUEST_BODY}>, _corrupt_record string"
)

_SCAN_FIELDS = (
    ("dr_id", "string"),
    ("scanned_at", "string"),
    ("streams_scanned", "array<struct<name: string, workflow_id: string, tasks: array<string>>>"),
    (
        "objects",
        "array<struct<fqn: string, type: string, access_mode: string, format: string, "
        "estimated_size_gb: double, clone_strategy: string>>",
    ),
    ("schemas_required", "array<string>"),
    ("total_objects", "bigint"),
    ("review_required", "boolean"),
    ("lineage_row_limit_hit", "boolean"),
    ("non_prod_additional_objects", "array<string>"),
)

# The manifest body, and the manifest as stored.
SCAN_RESULT = ", ".join(f"{name} {kind}" for name, kind in _SCAN_FIELDS)
MANIFEST = "scan_result struct<" + ", ".join(f"{name}: {kind}" for name, kind in _SCAN_FIELDS) + ">"

# Parts of the JSON texts that only some readers need.
PENDING_EDIT = (
    "pending_edit_id string, changes array<struct<field: string, before: string, after: string>>, "
    "proposed_config_json string, original_created_by string"
)
