"""Record shapes as DDL text, so that no reader needs an inference pass."""

MESSAGES = "array<struct<role:string,content:string>>"
TOOL_MESSAGES = (
    "array<struct<role:string,content:string,tool_calls:array<struct<name:string,arguments:string>>>>"
)

RAW_TOOL_MESSAGES = (
    "array<struct<role:string,content:string,tool_calls:array<struct<"
    "function:struct<name:string,arguments:string>,name:string,arguments:string>>>>"
)

TRAJECTORY = f"instance_id string, messages {MESSAGES}, patch string, model string, verified boolean"
TOKENIZED = "input_ids array<int>, completion_mask array<int>, seq_lengths array<int>"
TRAJECTORY_FILE = (
    "instance_id string, info struct<exit_status:string,submission:string,config:string>, "
    f"messages {MESSAGES}"
)
PREDICTIONS = "map<string,struct<model_patch:string,instance_id:string>>"
REPORT_COUNTS = (
    "total_instances",
    "submitted_instances",
    "completed_instances",
    "resolved_instances",
    "unresolved_instances",
    "empty_patch_instances",
    "error_instances",
)
REPORT = ", ".join(f"{c} bigint" for c in REPORT_COUNTS) + ", resolved_ids array<string>"
SUBSET = "description string, n_instances bigint, instance_ids array<string>, freq map<string,bigint>"
PUBLISHED = (
    "instance_id string, model string, run int, exit_status string, resolved boolean, "
    f"submission string, n_turns int, messages {MESSAGES}, warning string"
)
SWEEP_CONFIG = "label string, tag string, max_steps int, epochs int, examples int"
