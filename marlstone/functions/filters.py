"""Predicates and counts that decide whether text is kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import bound, strip, words

# Keywords of relevant chunks, phrases of page noise, signs of snippets that are no evidence, function words, and patterns of injected instructions.
KEYWORDS = [
    "afp", "acic", "check", "applicant", "identity", "result", "conviction", "screening", "compliance", "clearance", "criminal", "history", "verification", "employment",
    "disclosure", "legislation", "regulation", "wwcc", "children", "ndis", "aged care", "worker", "visa", "right to work", "fair work", "workplace", "privacy", "data protection", "spent conviction",
]
NOISE = ["cookie policy", "subscribe now", "all rights reserved", "follow us on", "privacy statement", "last updated by admin"]
NO_EVIDENCE = [
    "check that your question", "tips to get helpful answers", "ask a direct question", "check your spelling", "already been asked", "showing results for", "did you mean", "related searches",
    "people also ask", "nigeria police", "jamb result", "jamb updates", "unified tertiary matriculation", "nigerian", "nscdc", "india police", "fbi background", "advertisements", "click here to",
    "sign up for", "subscribe to", "download our app", "cookie policy", "privacy policy", "terms of service",
]
ENGLISH = "the and for with from that this are is to of in on as by or be can should will may at an a".split()
ROMANISED = "la quy trinh xac minh ly lich tu phap ung vien truoc khi nhan viec thuong ngay lam theo yeu cau anh huong den trong mot so cho ve duoc can noi bo dap dinh".split()
ACCENTED = "[àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ]"
DATED = r"^[A-Z][a-z]{2}[ \t]+[0-9]{1,2},[ \t]+[0-9]{4}[ \t]+[·\-]"
INJECTIONS = [
    r"ignore\s+(all\s+)?(previous|above|prior)\s+(instructions?|prompts?|rules?|context)", r"(disregard|forget|override)\s+(all\s+)?(previous|above|prior|your)\s+(instructions?|prompts?|rules?|context|guidelines)",
    r"^system\s*:", r"^(assistant|user|human)\s*:", r"you\s+are\s+now\s+(a|an|the)\s+", r"pretend\s+(you\s+are|to\s+be|you're)\s+", r"act\s+as\s+(if\s+)?(you\s+are|a|an)\s+",
    r"new\s+instructions?\s*:", r"(\[INST\]|\[/INST\]|<\|im_start\|>|<\|im_end\|>|<\|system\|>)",
]
MOST_PROMPT = 10_000


def keyword_hits(text: Column, keywords: list[str] = KEYWORDS) -> Column:
    """How many of the keywords stand in the text, not inside longer ASCII words."""

    def hits(low: Column) -> Column:  # the pattern is tried only where the keyword stands at all
        found = (F.when(F.contains(low, F.lit(k)), low.rlike(f"(^|[^a-z0-9]){k}($|[^a-z0-9])").cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k in keywords)
        return sum(found, F.lit(0).cast("bigint"))

    return bound(F.lower(text), hits)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z0-9][A-Za-z0-9'\\-]*")).cast("bigint")


def is_quality(text: Column, least_words: int = 28, least_hits: int = 2, keywords: list[str] = KEYWORDS) -> Column:
    return (word_count(text) >= max(1, least_words)) & (keyword_hits(text, keywords) >= max(2, least_hits))


def has_noise(text: Column) -> Column:
    return F.lower(text).rlike("|".join(NOISE))


def is_semantic(text: Column) -> Column:
    """Two or more sentences, no run of rule characters, and not mainly capitals."""
    parts = F.size(F.filter(F.split(text, "[.!?]+"), lambda x: strip(x) != ""))
    upper, lower = F.length(F.regexp_replace(text, "[^A-Z]", "")), F.length(F.regexp_replace(text, "[^a-z]", ""))
    return (parts >= 2) & ~text.rlike("[-*_=#]{4,}") & (lower > 0) & (upper <= 0.45 * (upper + lower))


def looks_english(text: Column) -> Column:
    w = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z'\\-]*"), F.lit(0))
    en = F.size(F.filter(w, lambda x: x.isin(ENGLISH)))
    vi = F.size(F.filter(w, lambda x: x.isin(ROMANISED)))
    return ~F.lower(text).rlike(ACCENTED) & (F.size(w) >= 6) & (en >= 1) & ~((vi >= 2) & (en <= 1))


def is_garbage(snippet: Column) -> Column:
    n = F.size(words(snippet))
    undated = F.regexp_replace(snippet, DATED + r"[ \t]*", "")
    return (
        F.lower(snippet).rlike("|".join(NO_EVIDENCE)) | (strip(snippet).endswith("...") & (n < 15)) | (snippet.rlike(DATED) & (F.size(words(undated)) < 10)) | (n < 8)
    )


def as_evidence(snippet: Column) -> Column:
    """Without a leading date, a closing ellipsis as a full stop."""
    x = F.regexp_replace(snippet, DATED + r"[ \t]*", "")
    return strip(F.regexp_replace(strip(x), r"\.\.\.$", "."))


def injections(text: Column) -> Column:
    """The numbers of the patterns of injected instructions that the text matches."""
    each = [F.when(text.rlike("(?im)" + p.replace(r"\s", "[ \t\r\n]")), F.lit(i)) for i, p in enumerate(INJECTIONS)]
    return F.array_compact(F.array(*each))


def guarded_prompt(text: Column) -> Column:
    """struct(valid, cleaned, reason, removed): control characters and long blank runs removed, then checked for attempts to inject instructions."""
    control = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"

    def checked(s: Column) -> Column:
        squeezed = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, control, ""), "[ \t]{10,}", "  "), "\n{4,}", "\n\n\n")

        def decided(c: Column) -> Column:
            attack = F.lit(False)
            for p in INJECTIONS:
                attack = attack | c.rlike("(?im)" + p.replace(r"\s", "[ \t\r\n]"))
            reason = F.when(s == "", "empty").when(F.length(s) > MOST_PROMPT, "too_long").when(attack, "unsafe").when(strip(c) == "", "empty_after_cleaning").otherwise("")
            return bound(reason, lambda r: F.struct(
                (r == "").alias("valid"), F.when(r.isin("empty", "empty_after_cleaning"), "").when(r == "too_long", F.substring(s, 1, MOST_PROMPT)).otherwise(c).alias("cleaned"), r.alias("reason"),
                F.when(r.isin("empty", "too_long"), 0).otherwise(F.regexp_count(s, F.lit(control))).cast("bigint").alias("removed")))

        return bound(squeezed, decided)

    return bound(strip(F.coalesce(text, F.lit(""))), checked)


def shape_of_draft(draft: Column) -> Column:
    """struct of counts on a markdown draft: words, level-two headings, images, list items."""
    d = F.coalesce(draft, F.lit(""))
    return F.struct(
        F.size(words(d)).cast("bigint").alias("words"), F.regexp_count(d, F.lit("(?m)^## ")).cast("bigint").alias("headings"),
        F.regexp_count(d, F.lit(r"!\[")).cast("bigint").alias("images"), F.regexp_count(d, F.lit("(?m)^- ")).cast("bigint").alias("items"),
    )
