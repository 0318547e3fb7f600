"""Values that results depend on and that therefore must not be changed."""

# --- fixed values -----------------------------------------------------------

# Rows whose source contains this (any case) are evaluation data, not training data.
CONTAMINATED_SOURCE = "gsm8k"

# Final answers are marked up as \boxed{...}.
BOX_OPENING = "\\boxed{"

# Label of rows without a source column, and of rows whose source is null.
SOURCE_COLUMN_MISSING = "unknown"
SOURCE_NULL = "None"

# Chat defaults.
MATH_SYSTEM_PROMPT = (
    "You are a rigorous math reasoning assistant. "
    "Reason step by step internally, then return only one final answer in the form \\boxed{...}. "
    "Do not include extra text after the boxed answer."
)
PSYCHOLOGY_SYSTEM_PROMPT = (
    "You are an expert psychological assistant. "
    "Analyze the scenario carefully, considering psychological principles and concepts, "
    "and provide a detailed explanation for your conclusion."
)
TURN_OPENING = "<|im_start|>"
TURN_CLOSING = "<|im_end|>\n"
RESPONSE_TEMPLATE = "<|im_start|>assistant\n"

# Token label that a loss function skips, and the longest token sequence kept.
IGNORED_LABEL = -100
MAX_TOKENS = 8192

# Sampling, ordering and splitting.
SEED = 42
SAMPLE_SIZE = 50_000
BATCH_SIZE = 32
TRAIN_SHARE = 0.90
TRAIN_AND_EVAL_SHARE = 0.95
HELD_OUT_CAP = 500

# Metric keys of a benchmark result, best first; a result with none of them scores 0.
METRIC_KEYS = {
    "hellaswag": ["acc_norm,none", "acc_norm"],
    "mmlu": ["acc,none", "acc"],
    "gsm8k": ["exact_match,strict-match", "exact_match", "acc"],
}

# Report columns in print order: benchmark, heading, width in the per-experiment report.
BENCHMARKS = [
    ("Reasoning", "Reasoning Acc (%)", 17),
    ("HellaSwag", "HellaSwag (%)", 15),
    ("MMLU", "MMLU (%)", 10),
    ("GSM8K", "GSM8K (%)", 10),
]
NOT_AVAILABLE = "N/A"
EXPERIMENT_WIDTH = 15
BENCHMARK_WIDTH = 20
SCORE_WIDTH = 15
