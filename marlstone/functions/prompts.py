"""What a prompt asks for: intent, tone, length, audience, topic, addresses and number of images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import AFTER, BEFORE, WS, one_line

# Words and phrases of requests in English and Vietnamese, and the defaults.
EDITS = ["edit", "revise", "update", "adjust", "fix", "sua", "chinh sua", "chỉnh sửa"]
IMAGES = "(?:image|images|picture|pictures|photo|photos)"
IMAGES_ALL = "(?:image|images|picture|pictures|photo|photos|anh|ảnh|hinh|hình)"
IMAGE_VERBS = "(?:keep|remove|reduce|limit|retain|only|show|use|make|set|change|add)"
IMAGE_VERBS_VI = "(?:chi|chỉ|giu|giữ|bo|bỏ|xoa|xóa|giam|giảm|them|thêm)"
REWRITES, SHORTENS = ["rewrite", "viet lai", "re-write"], ["shorter", "rut gon", "ngan hon", "tom tat"]
TONES = [("professional|chuyen nghiep", "professional"), ("friendly|than thien", "friendly"), ("casual|tu nhien", "casual")]
SHORT, LONG = "short|ngan|rut gon", "long|dai|chi tiet"
AUDIENCES = ["job seekers", "first-time job applicants", "employer", "hr", "backoffice", "nguoi moi"]
MARKERS = ["about", "regarding", "ve", "về"]
PRONOUNS = r"^(this +topic|this|it|the +topic|the +blog|the +draft|the +article|bai +nay|bài +này|no|nó)$"
NUMBERS = {"zero": 0, "one": 1, "two": 2, "three": 3, "mot": 1, "một": 1}
DEFAULTS = {"intent": "create_blog", "tone": "clear_professional", "length": "medium", "audience": "general audience", "topic": "current draft"}
_ENDS = "[ .,!?:;\n\t]+"


def _whole(pattern: str) -> str:
    return f"{BEFORE}(?:{pattern}){AFTER}"


def bare(c: Column) -> Column:
    """Without punctuation and blanks at its ends."""
    return F.regexp_replace(c, f"^{_ENDS}|{_ENDS}$", "")


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def intent(prompt: Column) -> Column:
    p = F.lower(prompt)
    edit = p.rlike(_whole("|".join(EDITS)))
    image = (
        p.rlike(f"{BEFORE}{IMAGE_VERBS}{AFTER}(?:.*[^\\p{{L}}\\p{{N}}_])?{IMAGES}{AFTER}") | p.rlike(f"{BEFORE}{IMAGES}{AFTER}(?:.*[^\\p{{L}}\\p{{N}}_])?{IMAGE_VERBS}{AFTER}")
        | p.rlike(f"{BEFORE}{IMAGE_VERBS_VI}{AFTER}(?:.*[^\\p{{L}}\\p{{N}}_])?(?:anh|ảnh|hinh|hình){AFTER}")
    )
    return F.when(edit | image | p.rlike("|".join(REWRITES)), "rewrite").when(p.rlike("|".join(SHORTENS)), "shorten").otherwise(DEFAULTS["intent"])


def tone(prompt: Column) -> Column:
    out = F
    for pattern, name in TONES:
        out = out.when(F.lower(prompt).rlike(pattern), name)
    return out.otherwise(DEFAULTS["tone"])


def length(prompt: Column) -> Column:
    p = F.lower(prompt)
    n = F.regexp_replace(F.regexp_extract(p, f"{BEFORE}([0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]{{3,4}}){WS}*(?:chu|tu|words?){AFTER}", 1), ",", "").try_cast("bigint")
    return (
        F.when(n <= 500, "short").when(n <= 1000, "medium").when(n > 1000, "long")
        .when(p.rlike(SHORT), "short").when(p.rlike(LONG), "long").otherwise(DEFAULTS["length"])
    )


def audience(prompt: Column) -> Column:
    p = F.lower(prompt)
    said = _filled(bare(F.regexp_extract(p, f"target_audience{WS}*:{WS}*([^\r\n]+)", 1)))
    known = F
    for a in AUDIENCES:
        known = known.when(F.contains(p, F.lit(a)), a)
    whom = _filled(F.trim(F.regexp_replace(F.regexp_extract(p, f"for{WS}+([a-z\\- \t\r\n]{{3,40}})", 1), f"^{WS}+|{WS}+$", "")))
    return F.coalesce(said, known.otherwise(None), whom, F.lit(DEFAULTS["audience"]))


def topic(prompt: Column) -> Column:
    """After a marker word, with pronouns read as the current draft; else the first line without its command words."""
    found = F.lit(None).cast("string")
    for m in MARKERS:
        t = _filled(bare(F.regexp_extract(prompt, f"(?i){BEFORE}{m}{WS}+([^\r\n]+)", 1)))
        found = F.coalesce(found, F.when(F.lower(t).rlike(PRONOUNS), DEFAULTS["topic"]).otherwise(t))
    line = F.trim(F.regexp_extract(F.regexp_replace(prompt, f"^{WS}+", ""), "^([^\r\n]*)", 1))
    short = F.regexp_replace(line, f"(?i)^(write|create|generate|draft|viet|viết|soan|soạn){WS}+", "")
    short = bare(F.regexp_replace(short, f"(?i)^(a{WS}+|an{WS}+)?(blog|article|post|bai{WS}+blog|bài{WS}+blog){WS}+", ""))
    first = F.when(F.length(short) >= 2, short).when(F.length(bare(line)) >= 2, bare(line))
    raw = F.coalesce(found, F.when(intent(prompt).isin("shorten", "rewrite"), DEFAULTS["topic"]), first, F.lit(DEFAULTS["topic"]))
    cut = F.regexp_replace(bare(raw), f"(?i),?{WS}*in{WS}+(a{WS}+)?(clear|professional|friendly|casual)[\\p{{L}}\\p{{N}}_ \t\r\n\\-]*tone\\.?$", "")
    cut = bare(F.regexp_replace(cut, f"(?i){WS}+for{WS}+({'|'.join(AUDIENCES)})\\.?$", ""))
    return F.coalesce(_filled(cut), F.lit(DEFAULTS["topic"]))


def web_urls(prompt: Column) -> Column:
    return F.filter(_urls(prompt), lambda u: ~u.rlike(_IMAGE))


def image_urls(prompt: Column) -> Column:
    return F.filter(_urls(prompt), lambda u: u.rlike(_IMAGE))


_IMAGE = r"(?i)\.(jpe?g|png|webp|gif|bmp|svg)(\?[^ ]*)?$"


def _urls(prompt: Column) -> Column:
    return F.regexp_extract_all(prompt, F.lit("(?i)https?://[^\t-\r ,\"'<>]+"), F.lit(0))


def image_limit(prompt: Column) -> Column:
    """How many images are asked for; 0 for none at all, null if nothing is said."""
    p = F.lower(one_line(prompt))
    none = (
        p.rlike(f"{BEFORE}(?:no|without) (?:any )?{IMAGES_ALL}{AFTER}") | p.rlike(f"{BEFORE}(?:khong|không) (?:co )?{IMAGES_ALL}{AFTER}")
        | p.rlike(f"{BEFORE}(?:remove|delete|drop) (?:all )?{IMAGES_ALL}{AFTER}") | p.rlike(f"{BEFORE}(?:xoa|xóa|bo|bỏ) (?:het |toan bo |tat ca )?{IMAGES_ALL}{AFTER}")
    )
    number = f"([0-9]+|{'|'.join(NUMBERS)})"
    kept = F.regexp_extract(p, f"{BEFORE}(?:keep|show|use|retain|limit(?:ed)? to|only|chi|chỉ|giu|giữ) (?:only )?{number} {IMAGES_ALL}{AFTER}", 1)
    said = F.when(kept != "", kept).otherwise(F.regexp_extract(p, f"{BEFORE}{number} {IMAGES_ALL}{AFTER}", 1))
    value = F
    for w, n in NUMBERS.items():
        value = value.when(said == w, F.lit(n).cast("bigint"))
    return F.when(none, F.lit(0).cast("bigint")).otherwise(value.otherwise(said.try_cast("bigint")))


#: Other names of intents, signs of a wish for steps, and signs against it.
INTENT_NAMES = {"rewrite": ("rewrite", "edit", "revise", "update", "modify"), "shorten": ("shorten", "summary", "summarize", "condense")}
STEPS = "step-by-step|step by step|how to|checklist|huong dan|hướng dẫn|guide|walkthrough"
NO_STEPS = "not step|non-step|khong theo buoc|không theo bước|khong tung buoc|không từng bước|editorial|thought leadership"


def intent_of_name(name: Column) -> Column:
    """A parser's word for an intent as one of three."""
    n = F.regexp_replace(F.lower(one_line(F.coalesce(name, F.lit("")))), " ", "_")
    out = F
    for k, names in INTENT_NAMES.items():
        out = out.when(n.isin(*names), k)
    return out.otherwise("create_blog")


def topic_of_name(name: Column, intent_: Column) -> Column:
    t = bare(one_line(F.coalesce(name, F.lit(""))))
    return F.when(t != "", t).when(intent_.isin("rewrite", "shorten"), "current draft").otherwise("general topic")


def tone_of_name(name: Column) -> Column:
    return F.coalesce(_filled(F.regexp_replace(F.lower(one_line(F.coalesce(name, F.lit("")))), " ", "_")), F.lit(DEFAULTS["tone"]))


def audience_of_name(name: Column) -> Column:
    return F.coalesce(_filled(F.lower(one_line(F.coalesce(name, F.lit(""))))), F.lit(DEFAULTS["audience"]))


def length_of_name(name: Column) -> Column:
    n = F.lower(one_line(F.coalesce(name, F.lit(""))))
    return F.when(n.isin("short", "medium", "long"), n).otherwise(DEFAULTS["length"])


#: How a prompt counts pictures.
PICTURE_COUNT = "([0-9]+)[\t-\r ]*(?:images?|ảnh|anh|hình|hinh|pictures?|photos?)"


def picture_count(prompt: Column) -> Column:
    return _filled(F.regexp_extract(F.lower(prompt), PICTURE_COUNT, 1)).try_cast("bigint")


def prefers_steps(prompt: Column) -> Column:
    p = F.lower(one_line(prompt))
    return ~p.rlike(NO_STEPS) & p.rlike(STEPS)


def is_police_check(topic_: Column) -> Column:
    t = F.lower(topic_)
    return F.contains(t, F.lit("police check")) | (F.contains(t, F.lit("police")) & F.contains(t, F.lit("background")))


def edits_images(prompt: Column) -> Column:
    """Whether a prompt that reads as a new article only asks for other images of the current one."""
    return image_limit(prompt).isNotNull() & (intent(prompt) == DEFAULTS["intent"])
