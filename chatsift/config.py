"""Parameters of the dataset build and of the chat-request operators.

The numeric defaults below are fixed values that must equal the original tool's
defaults for results to match. Prompt texts are our own neutral wording.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values (must match the original behaviour) ---------------------------------
ROLES_PROMPT = ("system", "user", "assistant")
ROLES_HISTORY = ("user", "assistant")
MIN_CHARS = 2
MAX_CHARS = 1200
SIGNATURE_SEPARATOR = "||"
DEFAULT_SEED = 42
DEFAULT_VALIDATION_RATIO = 0.02
# caps of the original's default build; pass them explicitly to get that build
CAP_PAIRS = 300_000
CAP_TURN_PAIRS = 80_000
CAP_CHAT = 10_000
CAP_TRANSLATION = 20_000
NO_CAP = 10**12  # a cap this large means "all rows" (the original's own "unlimited" value)
MAX_CONTEXT_MESSAGES = 8
CHAT_MAX_HISTORY_TURNS = 6
DEFAULT_MAX_NEW_TOKENS = 180
DEFAULT_TEMPERATURE = 0.85
DEFAULT_TOP_P = 0.92
DEFAULT_REPETITION_PENALTY = 1.08
REQUEST_MESSAGE_MAX = 4000
MAX_NEW_TOKENS_RANGE = (32, 512)
TEMPERATURE_RANGE = (0.0, 1.5)
TOP_P_RANGE = (0.1, 1.0)
CSV_HEADER = "input,output"
# pandas' default missing-value tokens (read_csv na_values default set)
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# ----------------------------------------------------------------------------------------

# Our own neutral defaults for texts the original tool hard-codes in its own language.
DEFAULT_SYSTEM_PROMPT = (
    "You are a friendly, helpful chat assistant. Answer in the user's language and tone, "
    "keep replies short unless asked for detail, and say so when you are unsure."
)
TRANSLATION_SYSTEM_PROMPT = (
    "You rewrite text into the requested script. Keep the meaning, output only the rewritten text."
)
TRANSLATION_INSTRUCTION = "Rewrite this sentence in the target script:"


@dataclass(frozen=True)
class SkewConfig:
    """Heavy-hitter handling for per-key sequence operators.

    A key with more than ``hot_key_rows`` rows is split into blocks of about ``block_rows`` rows
    (by sequence, scaled to the key's density); each block gets the trailing context of the blocks
    before it from a small summary.
    At most ``max_hot_keys`` keys are fetched to the driver; beyond that every key is blocked.
    Keys are counted on a seeded ``probe_fraction`` sample (raised automatically so a hot key
    expects at least 200 sampled rows); blocking is correct for any key, so the probe only has
    to find the big ones.
    """

    hot_key_rows: int = 1_000_000
    block_rows: int = 250_000
    max_hot_keys: int = 10_000
    probe_fraction: float = 0.01


@dataclass(frozen=True)
class BuildConfig:
    output_dir: str | None = None
    seed: int = DEFAULT_SEED
    validation_ratio: float = DEFAULT_VALIDATION_RATIO
    cap_pairs: int = NO_CAP  # a cap is an explicit choice: by default every row is used
    cap_turn_pairs: int = NO_CAP
    cap_chat: int = NO_CAP
    cap_translation: int = NO_CAP
    max_context_messages: int = MAX_CONTEXT_MESSAGES
    custom_dir: str | None = None
    multi_line: bool = True  # False: CSV fields hold no line ends, so large files split across tasks
    notes: tuple[str, ...] = ()
    local_pair_file: str | None = None
    system_prompt: str = DEFAULT_SYSTEM_PROMPT
    translation_system_prompt: str = TRANSLATION_SYSTEM_PROMPT
    translation_instruction: str = TRANSLATION_INSTRUCTION
    json_mode: str = "quarantine"  # or "failfast": bad JSON lines / CSV rows with a wrong field count
    shuffle_output: bool = True
    skew: SkewConfig = field(default_factory=SkewConfig)


@dataclass(frozen=True)
class ChatConfig:
    system_prompt: str = DEFAULT_SYSTEM_PROMPT
    max_history_turns: int = CHAT_MAX_HISTORY_TURNS
    max_new_tokens: int = DEFAULT_MAX_NEW_TOKENS
    temperature: float = DEFAULT_TEMPERATURE
    top_p: float = DEFAULT_TOP_P
    repetition_penalty: float = DEFAULT_REPETITION_PENALTY
    base_model: str = "base-model"
    adapter_path: str | None = None
    merged_model_path: str | None = None
    # prompt rendering markers (the real template belongs to the tokenizer)
    turn_prefix: str = "<|"
    role_suffix: str = "|>\n"
    turn_suffix: str = "\n"
    generation_marker: str = "<|assistant|>\n"

    @property
    def model_reference(self) -> str:
        for name in (self.merged_model_path, self.adapter_path):
            if name:
                return name
        return self.base_model
