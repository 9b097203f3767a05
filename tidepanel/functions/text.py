"""Text operators: injection flag, lenient response parsing, intent tags, follow-ups."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name of the operating platform as it may occur in a question; set it to the real one.
DEFAULT_PLATFORM = "the platform"
DEFAULT_ASSISTANT = "the assistant"


def injection_patterns(platform: str = DEFAULT_PLATFORM) -> list[str]:
    platform = re.escape(platform)
    # Phrases that mark an attempt to override the assistant.
    return [
        r"ignore (all |any )?(the |your )?previous instructions",
        r"disregard (all |any )?(the |your )?(previous|prior) instructions",
        r"forget (all |your )?(previous |prior )?instructions",
        r"reveal (your|the) system prompt",
        r"show (me )?(your|the) (system )?prompt",
        r"what (is|are) your (system )?(instructions|prompt)",
        r"pretend (that )?you (are|have|can)",
        r"act as (if )?you",
        r"you are now",
        r"jailbreak",
        r"bypass (your|the|any) (rules|instructions|guardrails|safety)",
        r"the dispute (was|has been|is) (submitted|filed|won)",
        r"confirm (that )?the dispute",
        rf"you have access to {platform}",
        rf"{platform}('s)? (internal|proprietary)",
        r"invent (some )?evidence",
        r"make up (some )?evidence",
        r"fabricate (some )?evidence",
    ]


def _mentions(text: Column, phrases: list[str]) -> Column:
    """Does the text hold any of the phrases?  Plain byte search, no regular expression."""
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def contains_injection(text: Column, platform: str = DEFAULT_PLATFORM) -> Column:
    """Case-insensitive match of any pattern, over the whole text.

    Every pattern but those with the platform's name holds one of the anchors, so texts without an
    anchor skip the regular expression.  The four letters outside ASCII that match an ASCII letter
    without regard to case are folded first, before lower() can split one of them in two.
    """
    anchors = ["instructions", "prompt", "pretend", "act as", "you are now", "jailbreak", "bypass", "the dispute", "evidence"]
    folded = F.lower(F.translate(text, "\u0131\u0130\u017f\u212a", "iisk"))
    matches = text.rlike("(?iu)" + "|".join(injection_patterns(platform)))
    # A name may fold in ways of its own: only a plain one can serve as an anchor.
    return _mentions(folded, [*anchors, platform.lower()]) & matches if platform.isascii() else matches


# Limits on parsed follow-up actions.
MAX_ACTIONS = 4
MAX_ACTION_LENGTH = 200


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def parse_response(raw: Column) -> tuple[Column, Column]:
    """(answer, actions) from text that should be a JSON object; the text itself if it is not."""
    body = strip(raw)
    doc = F.try_parse_json(body)

    def is_text(v: Column) -> Column:
        return F.schema_of_variant(v) == "STRING"

    field = F.try_variant_get(doc, "$.answer", "variant")
    answer = F.when(is_text(field), strip(F.try_variant_get(doc, "$.answer", "string")))
    usable = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT") & (F.length(answer) > 0), F.lit(False))
    listed = F.try_variant_get(doc, "$.suggested_next_actions", "array<variant>")
    texts = F.transform(F.filter(listed, is_text), lambda v: strip(F.try_variant_get(v, "$", "string")))
    kept = F.slice(F.filter(texts, lambda t: F.length(t) > 0), 1, MAX_ACTIONS)
    actions = F.transform(kept, lambda t: F.substring(t, 1, MAX_ACTION_LENGTH))
    empty = F.array().cast("array<string>")
    return F.when(usable, answer).otherwise(body), F.when(usable, F.coalesce(actions, empty)).otherwise(empty)


def out_of_scope_markers(assistant: str = DEFAULT_ASSISTANT) -> list[str]:
    # Phrases that put a question out of scope.
    return [
        "settlement hold",
        "enforcement",
        "internal risk score",
        "bank decision",
        "will i be approved",
        "will this be approved",
        "guarantee",
        "next year",
        "real world",
        "real-world probability",
        "production ready",
        "production-ready",
        "success rate",
        "learned from",
        f"has {assistant} learned",
        "outcome rate",
    ]


# Intent -> (keywords, section that must be present), first match wins.
INTENTS = {
    "draft": (["draft", "prepare", "response material"], "has_incident"),
    "incident": (["incident", "evidence", "missing", "summarize"], "has_incident"),
    "simulation": (["simulat", "what if", "modeled impact"], "has_simulation"),
    "intervention": (["recommend", "intervention", "should i", "what should", "consider"], None),
    "confidence": (["confidence", "confident", "data quality", "data-quality", "how sure", "how reliable"], None),
    "liquidity": (["liquidity", "cash", "buffer"], None),
    "risk": (["risk", "driver", "why", "elevated", "flag"], None),
}


def intent(question: Column, assistant: str = DEFAULT_ASSISTANT) -> Column:
    """Intent tag of a question; uses the has_incident and has_simulation columns."""
    text = F.lower(question)
    tag = F.when(_mentions(text, out_of_scope_markers(assistant)), "out_of_scope")
    for name, (keywords, section) in INTENTS.items():
        hit = _mentions(text, keywords)
        tag = tag.when(hit & F.col(section) if section else hit, name)
    return tag.otherwise("general")


# Suggested follow-up questions and the section each depends on.
FOLLOW_UPS = [
    ("Why is my risk elevated?", None),
    ("What does this mean for liquidity?", None),
    ("How confident is this assessment?", "has_data_quality"),
    ("What should I consider reviewing?", "has_interventions"),
    ("Explain the modeled impact of my simulation.", "has_simulation"),
    ("What evidence is still missing?", "has_incident"),
]


def suggested_follow_ups() -> Column:
    """The first four applicable follow-ups."""
    options = [F.when(F.col(s), F.lit(t)) if s else F.lit(t) for t, s in FOLLOW_UPS]
    return F.slice(F.array_compact(F.array(*options)), 1, MAX_ACTIONS)
