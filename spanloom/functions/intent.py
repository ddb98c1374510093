"""Intent category of a user prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text

# The cue pattern of each category; the first category that matches wins.
INTENT_PATTERNS = [
    (
        "debug",
        r"\b(debug|fix|bug|broken|error|fail(?:s|ing|ed)?|crash(?:es|ing|ed)?|not working|doesn'?t work|stack ?trace|exception|regress(?:ion)?|reproduce|why (?:is|does|isn'?t|doesn'?t).*(?:fail|break|crash|wrong)|unexpected(?:ly)?|misbehav)\b",
    ),
    (
        "test",
        r"\b(test|tests|testing|unit ?test|integration ?test|coverage|spec|specs|vitest|jest|pytest|assert(?:ion)?s?|e2e|end[- ]?to[- ]?end|run (?:the )?(?:tests?|e2e|suite))\b",
    ),
    (
        "refactor",
        r"\b(refactor|restructur\w*|clean ?up|renam\w*|extract|simplif(?:y|ied|ication)|reorganiz\w*|dedup(?:licate)?|tidy|deduplicate|decoupl\w*|untangl\w*|consolidat\w*|self[- ]?document\w*|duplicat(?:e|ion)|boilerplate|move (?:the|this)? ?(?:function|method|file|module)|(?:separate|split|pull|break) (?:out |apart |up )?the (?:logic|concerns?|responsibilit\w*|presentation|view|render\w*)|separate the logic|replace.*comments?.*(?:with|by)|comments?.*(?:replaced|should be).*(?:function|name))\b",
    ),
    (
        "explain",
        r"\b(explain|what (?:is|are|does|do|was)|how (?:does|do|is|can|to)|why (?:is|does|do|are|did|not)|understand|describe|walk me through|tell me about|summari[sz]e|document|remind me|does (?:it|that|this|the)|is (?:it|that|this|there)|are (?:we|there|they)|should (?:it|we|i|the)|can (?:the|it|we|you|i)|which (?:is|one|of)|isn'?t (?:it|that|there)|shouldn'?t)\b|\?\s*$",
    ),
    (
        "research",
        r"\b(research|look up|search (?:the )?(?:web|online|for)|find out|compare|investigate|latest|best practice|alternatives?|which (?:library|tool|framework))\b",
    ),
    (
        "ops",
        r"\b(deploy|deployment|ci\/?cd|pipeline|release|publish|install|upgrade|dependenc(?:y|ies)|version|commit|push|pull ?request|pr\b|merge|branch|rebase|config(?:ure|uration)?|env(?:ironment)? ?var|docker|kubernetes|k8s)\b",
    ),
    (
        "feature",
        r"\b(add|implement|create|build|introduce|support|new |feature|enable|wire up|set up|scaffold|break (?:it|this|them|the \w+) down into (?:\w+ )*steps?|break (?:it|this) down|turn .* into (?:\w+ )*steps?|step ?-?by ?-?step|write (?:a|the|some)? ?(?:function|component|endpoint|module|class|script))\b",
    ),
]

FALLBACK = "other"


TRAILING_QUESTION = r"|\?\s*$"


def with_intent(df: DataFrame, prompt: str, out: str) -> DataFrame:
    """Add one of the categories above for the text in column ``prompt``; never null."""
    clean = F.col("__prompt")
    chain = F.when(clean == "", FALLBACK)
    for category, pattern in INTENT_PATTERNS:
        # On trimmed text the last alternative of a pattern is a plain suffix test.
        hit = clean.rlike("(?i)" + pattern.removesuffix(TRAILING_QUESTION))
        if pattern.endswith(TRAILING_QUESTION):
            hit = hit | clean.endswith("?")
        chain = chain.when(hit, category)
    trimmed = text.trim(F.coalesce(F.col(prompt), F.lit("")))
    return (
        df.withColumn("__prompt", text.ascii_words(trimmed))
        .withColumn(out, chain.otherwise(FALLBACK))
        .drop("__prompt")
    )
