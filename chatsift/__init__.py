"""chatsift: turn conversational text tables into supervised fine-tuning datasets on Spark.

Everything here is a DataFrame operation: column expressions in ``functions``,
multi-row operators in ``operators``, readers in ``sources``, writers in ``sinks``,
end-to-end plans in ``plans`` and the keyed chat-session stream in ``streaming``.
"""

from chatsift.config import BuildConfig, ChatConfig, SkewConfig
from chatsift.functions.messages import clip_history, with_example
from chatsift.functions.text import normalize_text, py_strip
from chatsift.operators.context import array_examples, conversation_examples, trailing_context
from chatsift.operators.dedup import keep_first
from chatsift.operators.sampling import exact_split, sample_exact
from chatsift.plans.build import BuildResult, Sources, build_dataset

__all__ = [
    "BuildConfig", "BuildResult", "ChatConfig", "SkewConfig", "Sources", "array_examples", "build_dataset",
    "clip_history", "conversation_examples", "exact_split", "keep_first", "normalize_text", "py_strip",
    "sample_exact", "trailing_context", "with_example",
]
