"""Fixed values.

Everything in this file is data that results depend on: thresholds, token ids,
templates and patterns.  No logic lives here.
"""

# --- corpus building -------------------------------------------------------
MIN_MESSAGES = 3
MAX_ROWS_PER_KEY = 3
MAX_LINE_LENGTH = 50 * 1024 * 1024
EXTRA_FRACTION = (2, 5)  # extra text over verified text, as numerator and denominator
SAMPLE_ROWS = 100_000
MIX_SEED = 42
SHARD_SEED = 0

# --- token corpus ----------------------------------------------------------
PACK_LENGTH = 65536
PACK_BATCH_ROWS = 1000
IGNORED_LABEL = -100
DEGENERATE_SHARE = 0.3
TOKENS_PER_STEP = 65536 * 8
PACKS_PER_STEP = 8

VOCAB_RANK_LIMIT = 65535
SPECIAL_TOKENS = {
    "<|endoftext|>": 65535,
    "<|end|>": 65536,
    "<|user|>": 65537,
    "<|assistant|>": 65538,
    "<|system|>": 65539,
}
CHAT_TOKEN_IDS = (65536, 65537, 65538, 65539)

# Pre-tokenization alternatives, first match wins.
PRETOKEN_ALTERNATIVES = (
    r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
    r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
    r"\p{N}{1,3}",
    r" ?[^\s\p{L}\p{N}]+[\r\n/]*",
    r"\s*[\r\n]+",
    r"\s+(?!\S)",
    r"\s+",
)
PRETOKEN_PATTERN = "|".join(PRETOKEN_ALTERNATIVES)

# Norm of a chat token row after the output gain.
COLLAPSED_NORM = 0.22
HEALTHY_NORM = 0.85

# --- observations and actions ----------------------------------------------
ELIDE_LENGTH = 10000
ELIDE_KEEP = 5000
ELIDE_WARNING = (
    "The output of your last command was too long.\n"
    "Please try a different command that produces less output.\n"
    "If you're looking at a file you can try use head, tail or sed to view a smaller number of lines selectively.\n"
    "If you're using grep or find and it produced too much output, you can use a more selective search pattern.\n"
    "If you really need to see something from the full command's output, you can redirect output to a file"
    " and then search in that file."
)
ACTION_PATTERN = r"```bash\s*\n(.*?)\n```"
PATCH_PREFIX = "diff --git"
PATCH_FILE_PATTERN = r"diff --git a/(\S+)"
FORBIDDEN_PATH_PATTERN = r"(^|/)(test_[^/]*\.py|pyproject\.toml|setup\.cfg)$"
FINISHED_MARK = "exit=0"

# --- redaction: (pattern, label); {root}, {user} and {host} are filled in ----------
HOME_ROOTS = ("/fast", "/lustre/home", "/home")
HOME_RULE = (r"{root}/{user}/[^\s\"'<>]*", "{root}/<user>/<redacted>")
HOST_LABEL = "<internal-registry>"
ENDPOINT_RULE = (r"http://[a-z0-9\-]+:\d+/v1", "http://<vllm-host>/v1")

# --- evaluation ------------------------------------------------------------
POOL_SIZE = 446
SINGLE_ATTEMPT_RESOLVED = 13  # used when no run of a model is graded

# --- attempts --------------------------------------------------------------
LATE_SECONDS = 90 * 60
MAX_RESUBMITS = 3
CYCLE = "20 minutes"
QUEUE_IDLE, QUEUE_RUNNING, QUEUE_HELD = 1, 2, 5
EXECUTING_CODE = "001"
LOG_LINE_PATTERN = r"^(\d{3}) \((\S+)\) (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) "
SLICE_PATTERN = r"JOB_ID=(\d+) START=(\d+) END=(\d+)"
QUEUE_HEAD_PATTERN = r"^\s*(\d+)\s+(\d+)\s+"
QUEUE_RUN_PATTERN = r"BASE_OUTPUT_DIR=(\S+pass\d+-run\d+)"
QUEUE_JOB_PATTERN = r"JOB_ID=(\d+)"
