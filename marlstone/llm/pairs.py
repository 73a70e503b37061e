"""Broken prompt and response pairs, each with its type of defect.

Checks of one pair: an answer that holds nothing, that only gives the prompt back, or that is in another language, by
words whose language is learned from a bounded sample of the pairs. Two checks need the whole collection:

* Refusals. Response openings, with names and numbers masked, are counted, and all pairs of distinct ones that are
  similar are found by an exact join on their rarest shingles and verified. An opening and its similar ones are a template where they recur
  across unrelated prompts and say nothing more. A template reveals a refusal where it takes up nothing of its prompts and its
  words are those of refusals: weights of words are learned from openings that decline in the plainest words (the seeds). Openings in no template are held to the seeds and to rarer forms.
* Terminations. Whether a list item or a table cell may end in a word is learned from all items that are not
  last in their answer; an answer whose last item ends in a word that such items go on after is cut off.

Groups are combined before each shuffle: distinct openings and word counts are shuffled, never answers.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.samples import least_hashed
from marlstone.session import written

#: Openings of one template must share this much of their words and word pairs.
SIMILAR = 0.5
#: Prompts that a template must recur across, and the share of its openings that decline in seeds from which it is a refusal.
LEAST_PROMPTS, LEAST_DECLINING = 3, 0.5
#: Without seeds: the mean log odds of its words and word pairs that a refusal has, of at least so many words, and the share of its prompts' words it may take up.
LEAST_EVIDENCE, LEAST_WORDS, MOST_TAKEN_UP = 0.7, 4, 0.1
#: Openings and pairs from which words are learned: at most so many, those of least hash.
TRAIN_OPENINGS, TRAIN_PAIRS = 20_000, 4_000
#: Log odds by which one language must lead.
LEAD = 1.5
#: A word that ends fewer than this share of its complete list items doesn't end one.
LEAST_ENDING = 0.1

# --- fixed values -------------------------------------------------------------------------------------------------

NOTHING = set(
    """none null nil nan na n/a undefined empty blank nothing void missing unknown tbd tbc todo no_answer noanswer no answer|no response|no content|no reply|no text|not available|not applicable|no data|no output|nothing to show|empty response|
    ninguno|ninguna|nada|vacio|sin respuesta|sin contenido|no aplica|no disponible|khong co|trong|khong co noi dung|khong co cau tra loi|khong""".replace("\n", " ").split("|")
)
NOTHING |= set("none null nil nan na n/a undefined empty blank nothing void missing tbd tbc todo no_answer noanswer".split()) | {"no answer", "khong co"}
NOTHING -= {"khong", "trong"}

LANGUAGES = ("en", "es", "vi")
#: Function words of the languages, those of Vietnamese without accents.
STOPS = {
    "en": set(
        """the of and to a in is for on with that by as at from be are or an it this not which will must all again now when if each about should has have before after who how what does your you we may under their its i me my
        there they these those our was were would could than then where why because while until unless here been but so no yes please him her his she he them us am make""".split()
    ),
    "es": set(
        """el los las que y en un una por para del al es su lo como mas pero sus le ya este si porque esta cuando muy sin sobre tambien donde debe puede cada despues antes tiene entre cual quien ser son fue han sido estos estas ese esa
        nos les ni unos unas todo toda todos todas hasta desde segun durante mediante contra hacia yo mi usted ustedes cuanto cuanta cuantos estoy no""".split()
    ),
    "vi": set("va cua cac co cho khong duoc trong mot nhung voi nguoi khi tai nay den phai theo nen hoac neu moi sau truoc ve nao lam gi thi ma da dang bi vi sao nhu rat cung con ai dau day roi chua toi ban chung ho minh lai bao".split()),
}
#: Words of more than one list tell nothing.
_SHARED = {w for k in STOPS for w in STOPS[k] if sum(w in x for x in STOPS.values()) > 1}
STOPS = {k: v - _SHARED for k, v in STOPS.items()}
_VI_LETTERS = re.compile(r"[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]")
_ES_LETTERS = re.compile(r"[ñ¿¡]|(?<=[a-z])(?:ción|ciones|ía|ó)\b")
#: How prompts in the three languages name a language.
ASKED = {
    "en": re.compile(r"\b(?:english|ingl[eé]s|ti[eế]ng anh)\b", re.I),
    "es": re.compile(r"\b(?:spanish|espa[ñn]ol|castellano|ti[eế]ng t[aâ]y ban nha)\b", re.I),
    "vi": re.compile(r"\b(?:vietnamese|vietnamita|ti[eế]ng vi[eệ]t)\b", re.I),
    "other": re.compile(r"\b(?:translate|traduce|traduzca|traducir|d[iị]ch sang|french|german|chinese|arabic|hindi|korean|japanese|tagalog|italian|portuguese|mandarin|thai|another language|other language|otro idioma|ng[oô]n ng[uữ] kh[aá]c)\b", re.I),
}

_CAN_NOT = r"(?:can(?:no|')t|can not|could ?n(?:o|')t|won't|will not|shouldn't|should not|may not|must not|mustn't|do not|don't|am unable to|'m unable to|am not able to|'m not able to|am not (?:permitted|allowed|authori[sz]ed|going|supposed|in a position|comfortable|equipped|meant)(?: to)?|'m not (?:permitted|allowed|authori[sz]ed|going|supposed|in a position|comfortable|equipped|meant)(?: to)?|(?:must|have to|will have to|need to|would like to|am going to) (?:decline|refuse|pass|say no|turn)|would (?:prefer|rather) not|'d (?:prefer|rather) not|have been (?:told|asked|instructed) not|was (?:told|asked|instructed) not|decline|refuse)"
_TASK = r"(?:help|assist|answer|write|produce|provide|give|generate|create|draft|discuss|comply|continue|go (?:into|on|further)|take (?:this|that|it)|do (?:this|that|it|so)|respond|reply|comment|cover|complete|fulfil|proceed|share|support|talk|speak|offer|advise|touch|deal|engage|say|process|meet|carry|handle|prepare|this|that|it|request|to)"
#: The plainest: the writer can't, won't or mustn't.
SEEDS = [
    re.compile(rf"\b(?:i|we)\s?{_CAN_NOT}\b(?:\s\w+)?\s*{_TASK}?\b"),
    re.compile(rf"\b(?:i|we) (?:just |simply |really |currently |respectfully |therefore |politely )?{_CAN_NOT}\b"),
    re.compile(r"\b(?:no puedo|no podemos|no podre|no me es posible|no es posible|no me esta permitido|no estoy autorizad\w|no tengo permi\w+|me niego|debo (?:negarme|rechazar|declinar)|tengo que (?:negarme|rechazar|declinar)|prefiero no|no debo|no voy a|rechazo|no se me permite|no quiero)\b(?!.*\bdejar\b)|\bfuera de mi\b|\bno (?:responder|ayudar)e\b"),
    re.compile(r"\b(?:toi|minh|em|chung toi) (?:rat tiec )?(?:xin phep )?(?:khong the|khong duoc phep|khong the nao|khong duoc|xin tu choi|tu choi|phai tu choi|xin phep tu choi|khong muon|khong co quyen|buoc phai tu choi|danh phai tu choi|khong dam)\b|\bxin phep tu choi\b|\btu choi (?:yeu cau|tra loi|viet|ho tro)|\bvuot (?:qua )?(?:pham vi|kha nang|quyen)"),
]
#: Rarer forms, for openings that are in no template.
FORMS = [
    re.compile(r"\b(?:isn't|is not|it's not|not|wouldn't be|would not be) (?:possible|appropriate|right|something i|something that i|within my|in my power|allowed)\b.*\b(?:me|i|my|request|answer|help|this)\b"),
    re.compile(r"\b(?:falls|is|goes|lies|sits) (?:outside|beyond) (?:of )?(?:what i|my|the scope|the limits|what this)\b|\boutside (?:my|the) (?:scope|remit)\b|\bbeyond my (?:scope|remit|limits)\b"),
    re.compile(r"\bno (?:draft|answer|text|response|content|article|guide|help|reply|advice|information|output) (?:can|could|will|may) (?:be )?(?:offered|given|provided|written|produced|created|generated|supplied|shared)"),
    re.compile(r"\bmy (?:guidelines|instructions|rules|policy|policies|settings|role|training)\b.*\b(?:not|don't|doesn't|prevent|forbid|limit|prohibit|stop|keep)\b|\bthis is not something i\b|\bagainst (?:my|the|our) (?:rules|guidelines|polic)"),
    re.compile(r"^\W*(?:sorry,? )?(?:this|your|the) (?:request|question|topic|task) (?:is|has been|was|must be) (?:declined|refused|denied|rejected|not (?:allowed|permitted|supported))\b|^(?:request )?(?:declined|refused|denied)\W*$"),
]
#: Phrases in which the same words don't decline.
_NOT_DECLINING = re.compile(r"\bi (?:can't|cannot|can not|could not) (?:stress|recommend (?:this|it) (?:enough|highly)|wait|help but|thank|emphasi[sz]e|overstate|say enough)|\bsorry (?:to hear|for the (?:wait|delay))|\bno puedo dejar de|\b(?:don't|do not) (?:forget|worry|hesitate)\b")

# --- pieces -------------------------------------------------------------------------------------------------------

_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
_TAG = re.compile(r"<[^<>]{0,60}>|&nbsp;")
_LABEL = re.compile(r"^\W*(?:q|question|prompt|you asked|your (?:question|prompt|request)(?: was| is)?|user|user[_ ]prompt|request|instruction|input|task|asked|the (?:question|prompt|request)(?: was| is)?|pregunta|solicitud|usted pregunto|c[aâ]u h[oỏ]i|y[eê]u c[aầ]u|b[aạ]n h[oỏ]i)\s*[:：\-–—]\s*", re.I)
_ANY_LABEL = re.compile(r"^\W*[^\W\d][\w ]{1,24}[:：]\s+(?=\S)")
_NOTE = re.compile(r"^\s*(?:note|nota|l[uư]u [yý])\s*:[^\n.]*\.\s*", re.I)
_COURTESY = re.compile(r"^\W*(?:thanks|thank you|hello|hi|hey|dear user|gracias|hola|c[aả]m [oơ]n|xin ch[aà]o|ch[aà]o)\b[^.!\n]{0,40}[.!]\s+(?=\S)", re.I)
_SENT = re.compile(r"(?<=[.!?…])[\"'’”)*_]*\s+|\n+")
_ITEM = re.compile(r"^\s*(?:[-*•‣–]|\d{1,3}[.)]|\[[ xX]\]|[a-z]\))\s+(?=\S)")
_MARK_ONLY = re.compile(r"^\s*(?:[-*•‣–]|\d{1,3}[.)]|\[[ xX]?\]|#+|\|)\s*$")
_END = re.compile(r"[.!?。][\"'’”»)\]*_`]*$")
_TRAILER = re.compile(r"(?:\s*(?:[✅✔☑🙂😀👍🎉🔒📌]|[\U0001F300-\U0001FAFF]|\((?:source|sources|fuente|ngu[oồ]n|ref|see|via|xem|v[eé]ase)\b[^()\n]{0,160}\)|\[(?:source|sources|fuente|\d+|ref)\b[^\[\]\n]{0,160}\]|\[\^?\d+\]))+\s*$", re.I)
_LINK = re.compile(r"(?:https?://|www\.)[^\s<>]+[^\s<>.,;:\-…]$|\]\([^()\s]+\)$", re.I)
_OPEN = set("the a an of and or to in on at by for with from as is are was be must can should that which if when because unless but so than no not each every between before after into about under their its this these those who whose where until while per via y o de la el los las un una en con por para que se al del si cuando sin su va và của cho khi để tại với được và hoặc nếu trong các một không phải cần này từ đến".split())


def unaccented(text: str) -> str:
    if text.isascii():
        return text.lower()
    d = unicodedata.normalize("NFD", text.lower())
    return "".join(c for c in d if not unicodedata.combining(c)).replace("đ", "d").replace("’", "'")


_INVISIBLE = re.compile(f"[{''.join(chr(c) for c in range(0x80, 0xFFFF) if unicodedata.category(chr(c)) == 'Cf')}\U000e0000-\U000e007f\U0001d173-\U0001d17a]")


def visible(text: str) -> str:
    return text if text.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFC", text))


def words_of(text: str) -> list[str]:
    """The words without accents, in lower case."""
    return _WORD.findall(unaccented(text))


_MANY_WORDS = re.compile(r"(?:[^\W_]+[\W_]+){40}[^\W_]")


def is_empty(answer: str | None) -> bool:
    """Null, blank, only marks or empty markup, or a word for nothing."""
    if answer is None:
        return True
    if "<" not in answer and _MANY_WORDS.search(answer):
        return False
    t = _TAG.sub(" ", visible(answer))
    t = unaccented(re.sub(r"[\s()\[\]{}<>\"'`*_.,:;!\-–—#|~=/\\]+", " ", t)).strip()
    return not any(c.isalnum() for c in t) or t in NOTHING or t.replace(" ", "/") == "n/a"


Words = dict[str, tuple[float, float, float]]


def _plain_words() -> Words:
    """What function words tell of the language before anything is learned."""
    return {w: tuple(1.1 if k == own else -2.0 for k in LANGUAGES) for own in LANGUAGES for w in STOPS[own]}


def _scores(text: str, words: Words) -> list[float]:
    low = text.lower()
    en, es, vi = 0.0, 1.5 * len(_ES_LETTERS.findall(low)), 0.7 * len(_VI_LETTERS.findall(low))
    for w in words_of(low):
        if v := words.get(w):
            en, es, vi = en + v[0], es + v[1], vi + v[2]
    return [en, es, vi]


def language(text: str, words: Words, lead: float = LEAD) -> str | None:
    """en, es or vi, by words and letters; None where none leads clearly."""
    score = _scores(text, words)
    first, second = sorted(score, reverse=True)[:2]
    return LANGUAGES[score.index(first)] if first - second >= lead else None


def learned_words(texts: list[str | None], least: int = 3) -> Words:
    """Log odds of each language for the words of ``texts``, which function words and letters label where they lead by far.

    Every text counts a word once; words of fewer than ``least`` labelled texts are left out."""
    plain, count, of = _plain_words(), {k: Counter() for k in LANGUAGES}, Counter()
    for t in texts:
        if t and (k := language(t, plain, 3 * LEAD)):
            count[k].update({w for w in words_of(t) if not w.isdigit()})
            of[k] += 1
    out = dict(plain)
    for w in set().union(*count.values()):
        if sum(c[w] for c in count.values()) >= least:
            share = [(count[k][w] + 0.3) / (of[k] + 1) for k in LANGUAGES]
            mean = sum(share) / len(share)
            out[w] = tuple(max(-3.0, math.log(x / mean)) for x in share)
    return out


def other_language(prompt: str, answer: str, words: Words) -> bool:
    if any(p.search(prompt) for p in ASKED.values()):
        return False
    p = language(prompt, words)
    if p is None:
        return False
    body = _NOTE.sub("", answer)
    a = language(body, words)
    return bool(a and p != a and len(_WORD.findall(body)) >= 4)


def _adds(own: set[str], length: float, slack: float, answer: str) -> bool:
    """Whether a longer answer has so many words of its own, labels apart, that it can't be a copy: read up to the place where that is sure."""
    count, new = 0, set()
    for line in visible(answer).split("\n"):
        for w in words_of(_LABEL.sub("", _ANY_LABEL.sub("", line.lstrip(" >#*\"'“«-")))):
            count += 1
            if w not in own:
                new.add(w)
            if count > length and len(new) > slack:
                return True
    return False


def copies(prompt: str, answer: str) -> bool:
    """Whether the answer only gives the prompt back, whole or nearly so, perhaps labelled or repeated."""
    p = words_of(prompt)
    slack = max(0.15 * len(p), 1 if len(p) >= 4 else 0)
    if len(answer) > 40 + 8 * len(prompt) and _adds(set(p), len(p) + slack, slack, answer):
        return False
    lines = [x.lstrip(" >#*\"'“«-") for x in visible(answer).split("\n")]
    first = next((i for i, x in enumerate(lines) if x), 0)
    if _ANY_LABEL.match(lines[first]) and not _ANY_LABEL.match(prompt):
        lines[first] = _ANY_LABEL.sub("", lines[first])
    a = [w for x in lines for w in words_of(_LABEL.sub("", x))]
    if not p or not a or len(a) < 0.6 * len(p):
        return False
    own, left = Counter(p), 0
    if len(a) > 1.3 * len(p):  # repeated
        times = max(1, round(len(a) / len(p)))
        own = Counter({w: n * times for w, n in own.items()})
    extra = Counter(a) - own
    missing = Counter(p) - Counter(a)
    left = sum(extra.values())
    if left <= slack and sum(missing.values()) <= max(0.34 * len(p), slack):
        return True
    # small edits inside words
    if abs(len(a) - len(p)) <= slack:
        near = sum(x == y or (len(x) > 3 and sorted(x) == sorted(y)) for x, y in zip(p, a))
        return near >= 0.85 * len(p)
    return False


_DECLINE_HINT = re.compile(r"\b(?:i|we|my|request|no|not|isn't|refus|declin|reject|den|scope|toi|minh|em|tu choi|vuot|me|debo|tengo|prefiero|rechazo|fuera|remit|our)")


def _declines(sentence: str, forms: list[re.Pattern[str]]) -> bool:
    s = unaccented(sentence)
    if not _DECLINE_HINT.search(s):
        return False
    s = s.replace("i'm", "i 'm").replace("i'd", "i 'd")
    return any(d.search(s) for d in forms) and not _NOT_DECLINING.search(s)


_ADVICE = re.compile(r"\b(?:you could|you may|please (?:contact|ask|consult|try|speak)|try (?:asking|another|something)|let me know|ask .* directly|contact a|consult|instead\W*$|consulte|pruebe|pregunte|intente|puede (?:preguntar|consultar)|vui long|hay thu|ban co the|lien he|hoi )")


def opening(answer: str) -> tuple[str, str, bool, bool, bool]:
    """The opening sentence, its masked form, whether it declines in seeds and in rarer forms, and whether the rest adds nothing but advice."""
    body = answer
    for _ in range(2):
        body = _COURTESY.sub("", _NOTE.sub("", visible(body)), count=1)
    parts = [s.strip() for s in _SENT.split(body) if any(c.isalnum() for c in s)]
    if not parts:
        return "", "", False, False, True
    rest = more = 0
    for s in parts[1:]:
        if not (_declines(s, SEEDS) or _declines(s, FORMS) or _ADVICE.search(unaccented(s))):
            rest, more = rest + 1, more + len(_WORD.findall(s))
            if rest > 2 or more > 24:
                break
    first = parts[0]
    masked = re.sub(r"\d+", "0", first)
    masked = re.sub(r"(?<=\S )(?!I\b)[A-ZĐ][\w’'\-]*", "N", masked)
    return first, " ".join(words_of(masked)), _declines(first, SEEDS), _declines(first, FORMS), rest <= 2 and more <= 24


def ending(answer: str) -> tuple[str, str, str]:
    """(state, kind, word): `sound`, `cut`, or `ask` where the last word of a list item or cell decides."""
    raw = visible(answer)
    t = raw.rstrip()
    if t[:1] in "[{" and t[:2] not in ("[ ", "[x") and re.match(r"^[\[{]\s*[\"\[{]", t):
        try:
            json.loads(t)
            return "sound", "", ""
        except ValueError:
            return ("cut", "", "") if not re.match(r"^\[[^\]\n]+\]\(", t) else ("sound", "", "")
    if t.count("```") % 2:
        return "cut", "", ""
    if re.search(r"(?:…|\.\.\.)[\"'’”)*_]*$", t):
        return "cut", "", ""
    bare = _TRAILER.sub("", t)
    if bare != t and (_END.search(bare) or len(bare) < len(t)):
        return "sound", "", ""
    lines = [x for x in t.split("\n") if x.strip()]
    last = lines[-1].strip()
    if _MARK_ONLY.match(last):
        return "cut", "", ""
    if re.match(r"^#{1,6}\s", last):
        return ("cut", "", "") if len(lines) > 1 or raw.endswith("\n\n") else ("sound", "", "")
    if re.match(r"^\*\*[^*]+\*\*:?$", last) and len(lines) > 1:
        return "cut", "", ""
    if last.startswith("|"):
        cells = [x.count("|") for x in lines if x.strip().startswith("|")]
        whole = last.endswith("|") and len(last) > 1 and cells[-1] == cells[0] and (len(cells) > 2 or len(cells) == 2 and "---" not in last)
        return ("sound" if whole else "cut"), "", ""
    words = _WORD.findall(last)
    if _END.search(t) or _LINK.search(t):
        # a list whose other items have no full stop may still end in one
        return "sound", "", ""
    if re.search(r"[,;:(\[{\-–—/&+=]$", t):
        return "cut", "", ""
    if not words:
        return "sound", "", ""
    if _ITEM.match(lines[-1]):
        return "ask", "item", item_words(_ITEM.sub("", last))[-1]
    if words[-1].lower() in _OPEN and (len(words) > 1 or len(lines) > 1):
        return "cut", "", ""
    inner = re.search(r"[.!?]\s+\S", last)
    if not inner and len(lines) > 1 and len(words) <= 6 and (all(w[0].isupper() or w.lower() in ("of", "and", "the", "y", "de") for w in words) or re.match(r"^[-–—]\s?\S", last)):
        return "sound", "", ""  # a signature
    if not inner and len(lines) == 1 and len(words) <= 5:
        return "sound", "", ""  # a short answer
    if all(len(_WORD.findall(x)) <= 3 for x in lines) and len(lines) > 1:
        return "sound", "", ""
    return "cut", "", ""


def item_words(text: str) -> list[str]:
    """Words without accents, a number together with the word before it."""
    out: list[str] = []
    for w in _WORD.findall(text):
        w = unaccented(re.sub(r"\d+", "0", w))
        if w == "0" and out:
            out[-1] += " 0"
        else:
            out.append(w)
    return out


def _items(answer: str) -> list[str]:
    return [x for x in visible(answer).rstrip().split("\n") if x.strip() and _ITEM.match(x)]


# --- Spark --------------------------------------------------------------------------------------------------------


def chat_pairs(sessions: DataFrame) -> DataFrame:
    """(origin, record_id, turn_no, prompt, answer) of each turn; null turns are none, sessions saved again come once."""
    per = sessions.select(F.col("session_id").alias("record_id"), F.posexplode("turns").alias("turn_no", "t")).where("t is not null")
    return per.select(F.lit("chat").alias("origin"), "record_id", "turn_no", F.col("t.user_prompt").alias("prompt"), F.col("t.assistant_output").alias("answer"))


def report_pairs(report: DataFrame) -> DataFrame:
    return report.select(F.lit("resilience").alias("origin"), F.col("id").alias("record_id"), F.lit(0).alias("turn_no"), "prompt", F.col("draft").alias("answer"))


_CHECKED = "origin string, record_id string, turn_no int, defect string, phash bigint, open string, declines boolean, form boolean, only boolean, taken double, state string, kind string, word string"


def taken_up(prompt: str, answer: str) -> float:
    """The share of the prompt's longer words that stand in the answer."""
    own = {w for w in words_of(prompt) if len(w) > 3}
    return len(own.intersection(words_of(answer))) / len(own) if own else 0.0


def _checked(p: str, a: str | None, words: Words) -> tuple:
    """What is known of one pair by itself; what can't matter after an earlier defect isn't looked at."""
    if is_empty(a):
        return "empty", None, False, False, False, 0.0, "sound", "", ""
    if copies(p, a):
        return "copies_question", None, False, False, False, 0.0, "sound", "", ""
    _, masked, declines, form, only = opening(a)
    own = (masked or None, declines, form, only, taken_up(p, a) if only else 1.0)
    if only and (declines or form):
        return None, *own, "sound", "", ""
    if other_language(p, a, words):
        return "other_language", *own, "sound", "", ""
    return None, *own, *ending(a)


def _check_batches(words: Words):
    kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.float64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, a in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                p = p or ""
                key = xxhash.xxh64_intdigest(" ".join(unaccented(re.sub(r"\d+|(?<=\S )[A-ZĐ]\w*", "0", p)).split())) - 2**63
                defect, *rest = _checked(p, a, words)
                rows.append((defect, key, *rest))
            cols = list(zip(*rows)) or [()] * 10
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), *(pa.array(c, k) for c, k in zip(cols, kinds))], [x.split()[0] for x in _CHECKED.split(", ")])

    return run


def _ending_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch, how often each word stands in and ends the list items that are not last in their answer."""
    for b in batches:
        ends, stands = Counter(), Counter()
        for a in b.column(0).to_pylist():
            items = _items(a) if a else []
            for x in items[:-1]:
                w = item_words(_ITEM.sub("", x))
                if w:
                    ends[w[-1]] += 1
                    stands.update(w)
        yield pa.RecordBatch.from_arrays([pa.array(list(stands), pa.string()), pa.array([ends[w] for w in stands], pa.int64()), pa.array(list(stands.values()), pa.int64())], ["word", "n_end", "n_all"])


def _shingles(masked: str) -> set[str]:
    w = masked.split()
    return set(w) | {f"{x} {y}" for x, y in zip(w, w[1:])}


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each opening the hashes of its shingles, their number, and for each of 256 classes of hashes whether it has an odd number of them."""
    for b in batches:
        sizes, bits, tokens = [], [], []
        for o in b.column(1).to_pylist():
            h = {xxhash.xxh64_intdigest(s) for s in _shingles(o)}
            odd = 0
            for x in h:
                odd ^= 1 << (x >> 56)
            sizes.append(len(h))
            bits.append([(odd >> 64 * i & 2**64 - 1) - 2**63 for i in range(4)])
            tokens.append([x - 2**63 for x in h])
        cols = [pa.array([x[i] for x in bits], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), *cols, pa.array(tokens, pa.list_(pa.int64()))], ["id", "n", "b0", "b1", "b2", "b3", "tokens"])


def _near_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            p, q = _shingles(x), _shingles(y)
            keep.append(len(p & q) >= SIMILAR * len(p | q))
        yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def alike(openings: DataFrame) -> DataFrame:
    """(a, b): the ids of all pairs of ``openings`` (id bigint, open string) whose similarity is at least SIMILAR, each once.

    Exact: in one order of all shingles, rarest first, the first common shingle of such a pair lies among the first
    n - ceil(SIMILAR n) + 1 of the larger set and the first n - ceil(2 SIMILAR / (1 + SIMILAR) n) + 1 of the smaller. Pairs that
    meet there are dropped where their bitmaps prove them too unlike, and else verified on their words.
    """
    bits = ["b0", "b1", "b2", "b3"]
    sets = openings.select("id", "open").mapInArrow(_set_batches, "id bigint, n int, b0 bigint, b1 bigint, b2 bigint, b3 bigint, tokens array<bigint>")
    each = written(sets, "sets").select("id", "n", *bits, F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often > 1")  # the rest come first in the order and meet nothing
    own = each.join(often, "token").groupBy("id", "n", *bits).agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("shared"))

    def first(share: float) -> DataFrame:
        length = F.col("n") - F.ceil(F.col("n") * F.lit(share) - F.lit(1e-9)) + 1 - (F.col("n") - F.size("shared"))
        return own.select("id", "n", *bits, F.explode(F.slice("shared", F.lit(1), F.greatest(F.lit(0), length).cast("int"))).alias("s")).select("s.token", "id", "n", *bits)

    x, y = (first(share).select("token", *(F.col(c).alias(p + c) for c in ("id", "n", *bits))) for p, share in (("x", SIMILAR), ("y", 2 * SIMILAR / (1 + SIMILAR))))
    unlike = sum((F.bit_count(F.col("x" + c).bitwiseXOR(F.col("y" + c))) for c in bits), F.lit(0))
    larger = (F.col("xn") > F.col("yn")) | (F.col("xn") == F.col("yn")) & (F.col("xid") > F.col("yid"))
    near = (F.col("yn") >= F.col("xn") * F.lit(SIMILAR)) & (unlike <= (F.col("xn") + F.col("yn")) * F.lit((1 - SIMILAR) / (1 + SIMILAR)) + F.lit(1e-9))
    met = x.join(y, "token").where(larger & near).select(F.col("xid").alias("a"), F.col("yid").alias("b")).distinct()
    text = openings.select("id", "open")
    both = met.join(text.toDF("a", "x"), "a").join(text.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(_near_batches, "a bigint, b bigint")


Weights = dict[str, float]


def learned_weights(openings: list[tuple[str, bool, bool]]) -> Weights:
    """Log odds of refusal for the shingles of (opening, declines in seeds, is of no template): those of seeds against those that content follows or that take up the prompt."""
    yes, no, of_yes, of_no = Counter(), Counter(), 0, 0
    for text, declines, ordinary in openings:
        if declines:
            yes.update(_shingles(text))
            of_yes += 1
        elif ordinary:
            no.update(_shingles(text))
            of_no += 1
    return {x: math.log((yes[x] + 0.5) / (of_yes + 1)) - math.log((no[x] + 0.5) / (of_no + 1)) for x in yes.keys() | no.keys()} if of_yes else {}


def evidence(masked: str, weights: Weights) -> float:
    """The mean log odds of refusal over the opening's shingles; of openings of few words, nothing."""
    s = _shingles(masked)
    return sum(weights.get(x, 0.0) for x in s) / len(s) if masked.count(" ") + 1 >= LEAST_WORDS else -9.0


def _evidence_batches(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([evidence(x, weights) for x in b.column(1).to_pylist()], pa.float64())], [*b.schema.names, "evidence"])

    return run


def refusal_templates(checked: DataFrame) -> DataFrame:
    """(open): masked openings that, with those similar to them, recur across unrelated prompts and refuse.

    Only openings that most of their answers don't go beyond can be such templates, so no others are compared.
    """
    counted = checked.where("open is not null").groupBy("open").agg(
        F.max("declines").alias("declines"), F.count(F.lit(1)).alias("n"), F.avg(F.col("only").cast("double")).alias("alone"), F.avg("taken").alias("taken"))
    counted = written(counted, "openings")
    ordinary = (F.col("alone") < 0.5) | (F.col("taken") > MOST_TAKEN_UP)
    sample = least_hashed(counted.select("open", (F.col("declines") & (F.col("alone") >= 0.5)).alias("declines"), ordinary.alias("ordinary")), TRAIN_OPENINGS, 5)
    weights = learned_weights([(x.open, x.declines, x.ordinary) for x in sample])
    # id: of 64 bits, at 10^10 different openings a few collisions must be expected
    alone = counted.where("alone >= 0.5").select(F.xxhash64("open").alias("id"), "open", "declines", "n", "taken")
    each = written(alone.mapInArrow(_evidence_batches(weights), "id bigint, open string, declines boolean, n bigint, taken double, evidence double"), "alone")
    near = written(alike(each), "alike")
    own = each.select(F.col("id").alias("a"), F.col("id").alias("b"))
    near = near.select("a", "b").unionAll(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionAll(own)
    of = each.select(F.col("id").alias("b"), "n", F.when(F.col("declines"), F.col("n")).otherwise(0).alias("yes"), (F.col("n") * F.col("taken")).alias("taken"), (F.col("n") * F.col("evidence")).alias("evidence"))
    whole = near.join(of, "b").groupBy("a").agg(*(F.sum(c).alias(c) for c in ("n", "yes", "taken", "evidence")))
    refuses = (F.col("yes") >= F.col("n") * LEAST_DECLINING) | (F.col("evidence") >= F.col("n") * LEAST_EVIDENCE) & (F.col("taken") <= F.col("n") * MOST_TAKEN_UP)
    asked = checked.where("open is not null and only").select(F.xxhash64("open").alias("b"), "phash").distinct()
    recur = near.join(whole.where(refuses).select("a"), "a").join(asked, "b").groupBy("a").agg(F.countDistinct("phash").alias("prompts")).where(F.col("prompts") >= LEAST_PROMPTS)
    return each.join(recur.select(F.col("a").alias("id")), "id").select("open")


def broken_pairs(pairs: DataFrame) -> DataFrame:
    """(origin, record_id, turn_no, defect) of each defective pair of (origin, record_id, turn_no, prompt, answer).

    One defect at most: `empty`, `copies_question`, `refusal`, `other_language`, `truncated`, in this order. A null prompt counts as
    empty: its answer can't copy it nor differ from its language. Pairs delivered again with equal texts count once. Extra columns are ignored.
    """
    own = pairs.select("origin", F.col("record_id").cast("string").alias("record_id"), F.col("turn_no").cast("int").alias("turn_no"), "prompt", "answer").distinct()
    words = learned_words([t for x in least_hashed(pairs.select("prompt", "answer"), TRAIN_PAIRS, 4) for t in (x.prompt, x.answer)])
    checked = written(own.mapInArrow(_check_batches(words), _CHECKED), "pairs")
    template = refusal_templates(checked).withColumn("template", F.lit(True))
    ends = pairs.select("answer").mapInArrow(_ending_batches, "word string, n_end bigint, n_all bigint").groupBy("word").agg(F.sum("n_end").alias("n_end"), F.sum("n_all").alias("n_all"))
    # keys of rows that need no look-up match nothing, and differ so that they spread over the tasks
    none = F.concat(F.lit("\n"), F.xxhash64("record_id", "turn_no").cast("string"))
    key = lambda asks, c: F.when(asks, F.col(c)).otherwise(none)
    keyed = checked.withColumns({"word": key(F.col("state") == "ask", "word"), "open": key(F.col("only") & F.col("open").isNotNull(), "open")})
    asked = keyed.join(template, "open", "left").join(ends, "word", "left")
    refusal = F.col("only") & (F.col("declines") | F.col("form") | F.coalesce("template", F.lit(False)))
    cut = (F.col("state") == "cut") | ((F.col("state") == "ask") & (F.coalesce("n_end", F.lit(0)) < F.lit(LEAST_ENDING) * F.coalesce("n_all", F.lit(1))))
    defect = (
        F.when(F.col("defect").isin("empty", "copies_question"), F.col("defect")).when(refusal, F.lit("refusal"))
        .when(F.col("defect").isNotNull(), F.col("defect")).when(cut, F.lit("truncated"))
    )
    return asked.select("origin", "record_id", "turn_no", defect.alias("defect")).where("defect is not null").distinct()
