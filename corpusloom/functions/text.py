"""Column expressions over text; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``\s`` has it; Java's own class is ASCII only.
BLANK = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2ebef}\x{30000}-\x{323af}]"
WORD = r"[A-Za-z]+(?:['’][A-Za-z]+)*"
NUMBER = r"(?<![\p{L}\p{N}_])\d+(?:[.,]\d+)*(?:%)?"


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, BLANK + "+", " "), r"^ | $", "")


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(text, BLANK + "+", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def strip_line_end(text: Column) -> Column:
    """Without one line feed at the end and one carriage return before it."""
    return F.regexp_replace(text, r"\r?\n?\z", "")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def han_count(text: Column) -> Column:
    return count(text, HAN)


def word_count(text: Column) -> Column:
    return count(text, WORD)


def length_in(language: Column, text: Column) -> Column:
    """Han letters for zh, words for en; the two must never be pooled."""
    return F.when(language == "zh", han_count(text)).when(language == "en", word_count(text))


def script_language(text: Column) -> Column:
    """unknown, zh, mixed or en by the Han and Latin letters of a text."""
    han, latin = count(text, r"[\x{3400}-\x{9fff}]"), count(text, "[A-Za-z]")
    return (
        F.when((han == 0) & (latin == 0), "unknown")
        .when(han > F.greatest(F.lit(20.0), latin * 0.2), "zh")
        .when(han > F.greatest(F.lit(20.0), latin * 0.03), "mixed")
        .otherwise("en")
    )


def change_pct(before: Column, after: Column) -> Column:
    return (after / F.nullif(before, F.lit(0)) - 1) * 100


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def seeded_score(seed: str, key: Column) -> Column:
    """Hex digest of the seed, a NUL and the key: a reproducible random order."""
    return F.sha2(F.concat(F.lit(seed), F.lit("\x00"), key).cast("binary"), 256)


def short_id(prefix: Column, text: Column, size: int = 24) -> Column:
    return F.concat(prefix, F.lit(":"), F.substring(sha(text), 1, size))


def profile_of(model: Column) -> Column:
    """The model's name without its maker and dots."""
    return F.regexp_replace(F.regexp_extract(model, r"^(?:[^/]*/)?(.*)$", 1), r"\.", "")


def partition_at(text: Column, mark: str = ":") -> tuple[Column, Column]:
    """What comes before the first mark and after it (less one blank); without a mark all is input."""
    at = F.instr(text, mark)
    head = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(F.lit(""))
    tail = F.when(at > 0, F.regexp_replace(F.substring(text, at + 1, F.length(text)), "^ ", "")).otherwise(text)
    return head, tail


def token_bound(text: Column) -> Column:
    return F.octet_length(text) + 4096


def output_cap(text: Column) -> Column:
    return F.least(F.lit(60000), F.greatest(F.lit(4096), F.octet_length(text) * 2))


def numbers(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))))


def majority_label(votes: Column, least: int = 3) -> Column:
    return F.when(votes >= least, "equivalent").otherwise("divergent")


#: Labels of provider errors and the patterns that show them, in this order.
ERROR_LABELS = [
    ("schema_too_many_states", r"too many states"),
    ("schema_complexity", r"(schema.{0,100}(complex|too large|too deep|exceed))|((complex|too large|too deep).{0,50}schema)"),
    ("schema_unsupported_field", r"unknown name|unsupported.{0,50}(schema|field|property)|cannot find field"),
    ("schema_type_mismatch", r"(schema|type).{0,70}(mismatch|expected|invalid type)"),
    ("schema_empty_required_field", r"(should|must).{0,20}(non-empty|non empty)"),
    ("invalid_argument", r"invalid.?argument|invalid argument"),
    ("context_length_exceeded", r"context.{0,30}(length|limit)|input token count.{0,50}exceed"),
    ("max_output_tokens_invalid", r"(max_tokens|maxoutputtokens|max output tokens).{0,80}(limit|exceed|invalid|range)"),
    ("no_eligible_endpoint", r"no endpoints|no available provider|no provider available"),
    ("insufficient_credits", r"insufficient.{0,30}(credit|fund|balance)|credit.{0,30}(insufficient|exhaust)"),
    ("authentication_error", r"authentication|unauthorized|invalid api key"),
    ("permission_denied", r"permission.denied|forbidden"),
    ("rate_limit", r"rate.limit|too many requests"),
    ("provider_error", r"provider returned error|upstream error"),
]


def error_labels(message: Column) -> Column:
    """The labels that fit a message, keys redacted before; one catch-all where none fits."""
    text = F.lower(F.regexp_replace(message, r"(?i)sk-[a-z0-9_-]+", "[REDACTED]"))
    found = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in ERROR_LABELS]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unclassified_provider_error")))
