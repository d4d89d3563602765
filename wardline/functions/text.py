"""Question classifiers and text clean-up as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrase lists of the privacy, injection, ambiguity and follow-up rules.
HIGH_RISK_PHRASES = ("patient-level", "patient ids", "patient_id", "export all", "individual records")
SENSITIVE_PHRASES = ("race", "ethnicity", "birth_date", "patient_id", "residential_region")
INJECTION_PHRASES = (
    "ignore previous", "system prompt", "developer message", "bypass safeguards", "disable validation",
    "execute arbitrary",
)
AMBIGUOUS_PHRASES = ("which hospital is worst", "best hospital")
FOLLOW_UP_MARKERS = (
    "what about", "how about", "and in ", "and for ", "compared with that", "compared to that", "break that down",
    "show those", "why is that", "which of those", "same for", "instead", "previous result",
)
FOLLOW_UP_WORDS = ("those", "that", "them", "it")
HIGH_RISK_WARNING = "Patient-level output and unrestricted exports are denied."
SENSITIVE_WARNING = "Sensitive demographic access requested; small groups require suppression."
INJECTION_WARNING = "Potential prompt-injection language detected; instructions were ignored."
SECRET_PATTERN = r"sk-[A-Za-z0-9_*\-]{8,}"
SECRET_MASK = "[REDACTED_API_KEY]"
MESSAGE_LIMIT = 500


def _contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [text.contains(p) for p in phrases])


def classify_risk(question: Column) -> Column:
    text = F.lower(question)
    return (
        F.when(_contains_any(text, HIGH_RISK_PHRASES), "high")
        .when(_contains_any(text, SENSITIVE_PHRASES), "medium").otherwise("low")
    )


def risk_warning(risk: Column) -> Column:
    return F.when(risk == "high", HIGH_RISK_WARNING).when(risk == "medium", SENSITIVE_WARNING)


def injection_flag(question: Column) -> Column:
    return _contains_any(F.lower(question), INJECTION_PHRASES)


def ambiguous_request_flag(question: Column) -> Column:
    return _contains_any(F.lower(question), AMBIGUOUS_PHRASES)


def follow_up_flag(question: Column) -> Column:
    """A follow-up marker anywhere, or at most five words with a pointing word among them."""
    text = F.lower(F.trim(question))
    words = F.split(normalize_text(question), " ")
    pointing = F.arrays_overlap(words, F.array(*[F.lit(w) for w in FOLLOW_UP_WORDS]))
    return _contains_any(text, FOLLOW_UP_MARKERS) | ((F.size(words) <= 5) & pointing)


def normalize_text(question: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(question), r"\s+", " "))


def question_year(question: Column, years: tuple[int, ...] = (2025, 2024)) -> Column:
    """First of ``years`` named in the text, else the first year."""
    picked = reduce(
        lambda chain, year: chain.when(question.contains(str(year)), year), years[1:],
        F.when(question.contains(str(years[0])), years[0]))
    return picked.otherwise(years[0])


def redact_secrets(
    text: Column, pattern: str = SECRET_PATTERN, mask: str = SECRET_MASK, limit: int | None = MESSAGE_LIMIT
) -> Column:
    """Mask every match; an error message is then cut to ``limit`` characters (``None`` keeps whole texts)."""
    masked = F.regexp_replace(text, pattern, mask)
    return masked if limit is None else F.substring(masked, 1, limit)


def request_status(question: Column) -> Column:
    """Outcome a question gets before any query runs: denied, clarification_required or accepted."""
    return (
        F.when(classify_risk(question) == "high", "denied")
        .when(ambiguous_request_flag(question), "clarification_required").otherwise("accepted")
    )
