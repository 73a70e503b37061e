"""Template residue, filler, error pages and script notices in place of content.

A text is cut into sentences, and each is tried against grammars: one for each delimiter that template systems
use, and one for each family of notices. A hit is then weighed by its surroundings.

* Code. Fenced and indented blocks are left out, code spans and quotations within a longer sentence count nothing.
* Tutorials. A template place loses weight where its sentence speaks of its kind of markup, where a neighbouring sentence does,
  and by the share of the document's sentences that do.
* Notices. The density of notice words decides whether a sentence, however long, *is* a notice or only speaks of one. Notice words are
  function words and the words of the grammars themselves, by their stems, with few others.

Cheap tests for parts of words come before every grammar. One pass over Arrow batches, no shuffle; each text is
read whole. Null, empty and blank texts are never cases.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------------------------

#: Words of the pseudo-Latin filler text that typesetters use, and of its common generators.
LATIN_FILLER = set(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
    enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in
    reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa
    qui officia deserunt mollit anim id est laborum curabitur pretium tincidunt lacus gravida orci a odio nullam varius turpis
    commodo pharetra bibendum justo morbi vitae sodales cursus facilisis mauris vestibulum praesent suspendisse phasellus
    vivamus pellentesque donec maecenas quisque aenean fusce nunc integer proin etiam vel eget ac bonorum malorum finibus""".split()
)
#: Words that people hit to fill a field.
KEYBOARD_FILLER = set("asdf asdfgh asdfghjkl qwerty qwertyuiop zzz xxx xxxx aaa aaaa test testing text foo bar baz blah bla yada abc".split())

#: Function words.
FUNCTION_WORDS = {
    "en": set(
        """a about again all already also am an and another any are aren as at be because been before but by can cannot could did do does doesn don down else etc for from get go gone goes got had has have here how i if in is isn it its
        just kindly let ll may maybe me might more most moment must my need no none not nothing now of off oh ok on once one only oops or other otherwise our out own please re s should so some something soon sorry still t than thanks
        that the their them then there these they thing this to too under until up us ve very was way we well went were what when where which whoops who will with without would you your yet""".split()
    ),
    "es": set("a al ante antes como con cuando de del desde donde el ella en entre es esta estamos estan este estos ha han hay la las le les lo los mas mientras muy nos o para pero por porque que se ser si sin sobre son su sus tambien un una unos usted y ya favor gracias".split()),
    "vi": set("ban cac cua cho co con da de den do duoc hoac khi khong la lai luc moi mot nay nen neu nhung o quy sau se tai the theo thi trong tu va ve vi voi xin vui long hay roi".split()),
}
#: Words, by their stems, that notices hold beside function words and the words of the grammars below.
NOTICE_STEMS = set(
    """active administrator ago apologies apologise apologize appear ask automatically cache call captcha category claim click client close configuration continue cookie currently day e email exceed exception experienced failure fatal
    firewall fix function hour important inc incident include invalid issue javascript key last launch layer looking make message method minute missing module nan network new nojs null number object order organisation part path picture post powered
    press problem proceed properly query ray received recent redirected reference render report resolve result retry review run second secure security seem setting side start stop stream string technical temporary temporarily timeout
    todo trace traceback traffic ua unauthorized undefined unfortunately upgrade usable use used user using valid value version visit wait webpage website wip x""".split()
)
#: Words of the grammars that ordinary sentences hold as often.
ORDINARY = {"withdrawn", "photo", "form", "guide", "note", "summary"}

#: What may stand between a notice's subject and what it says of it: no clause of its own.
_GAP = r"(?:(?!\b(?:if|when|where|unless|because|since|once|after|before|until|so)\b)[^.!?]){0,60}?"
_SCRIPT = r"java\s?script|\bjs\b|\bscripts?\b|\bscripting\b"
#: What sentences of each family say, for lower-case text without accents of code.
NOTICES: list[tuple[str, str]] = [
    ("script", rf"(?:{_SCRIPT}).*\b(?:enabled?|required|needed|disabled|blocked|unblock|switch(?:ed)?|turn(?:ed)?|off|allow(?:ed)?|activated?|support(?:ed)?|necessary|reload|refresh)\b"),
    ("script", rf"\b(?:enabl\w+|turn(?:ing)? (?:it )?on|switch(?:ing)? (?:it )?on|allow\w*|unblock\w*|activat\w+|requires?|needs?|without|support|supports|disabl\w+|turned off|switched off|blocks?|blocking)\b.*(?:{_SCRIPT})"),
    ("script", r"\b(?:checking|verifying|validating|testing|inspecting)\b.*\b(?:browser|connection|you are (?:a )?human|human)\b|\bbrowser\b.*\b(?:is being|being) (?:checked|verified|tested)\b|\bverify (?:that )?you(?:'re| are) (?:a |not a )?(?:human|robot|bot)|\bnot a robot\b|\bddos protection\b|\bone moment\b.*\b(?:browser|check)"),
    ("script", r"\benable (?:it|them) and (?:reload|refresh|try)|^(?:please )?(?:refresh|reload) (?:the|this) page\W*$"),
    ("error", r"\b(?:error|http|status|code)\s*[:#/-]?\s*(?:code\s*)?[45]\d\d\b|\b[45]\d\d\b\s*[-:–—|]?\s*\(?(?:error|not found|forbidden|unauthori[sz]ed|bad (?:request|gateway)|internal|service unavailable|gateway|too many)"),
    ("error", r"\b(?:page|document|address|record|site|index|server|service|link|database|file|resource|url|article|content|system|portal|form|account|session|connection|application|app|feed|search|store|host|listing|item|entry|request|view|folder|gateway)\b" + _GAP + r"\b(?:(?:can(?:no|')t|could ?n[o']t|can not|not) be (?:found|reached|loaded|opened|displayed|shown|served|read|completed|processed)|not found|no longer (?:exists?|available|here|online)|does(?: not|n't) exist|(?:been|was|has|or|is) (?:moved|deleted|removed|withdrawn|taken down|renamed)|did(?: not|n't) (?:answer|respond|load)|timed? ?out|overloaded|not available|unavailable|unexpected (?:reply|error|response)|not (?:respond|answer)\w*|down for|offline|under(?:going)? maintenance|for (?:signed|logged|registered|authori[sz]ed)|only be (?:opened|seen|viewed|read) by|has expired|forbidden|restricted)\b"),
    ("error", r"\b(?:could ?n[o']t|can(?:no|')t|unable to|failed to|not able to) (?:reach|find|load|connect|open|display|show|process|locate|complete) (?:the|this|that|your|to|what)\b"),
    ("error", r"^\W*(?:(?:sorry|error|notice|oops|whoops|warning)\W+)?(?:your |this |the )*(?:access|request|connection|login|ip)\b[^.!?]{0,40}?\b(?:denied|forbidden|refused|restricted|blocked|rejected)\b|\brefused (?:the|your|to) (?:connect\w*|request)|\bupstream connect error|\bdisconnect before headers|\breset reason\b|\byou (?:lack|need|do not have|don't have|have no) (?:the )?(?:permission|access|rights?)|\bnot (?:authori[sz]ed|permitted|allowed) to (?:view|access|see|open)|\btoo many requests\b|\brate limit"),
    ("error", r"\b(?:try|come|check) (?:it |this )?(?:again|back) (?:later|soon|shortly|in a (?:few|moment)|in \d+)|\bback (?:shortly|soon|online)\b|\bdown for (?:scheduled |planned |routine )?maintenance|\b(?:scheduled|planned) (?:maintenance|outage)\b|\binternal server error|\b(?:bad gateway|gateway time-?out|service unavailable|connection (?:refused|reset|timed out))\b|\bsomething went wrong\b|\ban? (?:unexpected |internal |unknown )?error (?:has )?occurred"),
    ("error", r"\b(?:go|return|head) (?:back )?to (?:the |our )?home ?page\b|\btry (?:the|our) (?:search|site map|sitemap)|\bcontact the (?:site|server|web) ?(?:owner|admin\w*|master)"),
    ("filler", r"\b(?:dummy|placeholder|filler|lipsum)\b.*\b(?:copy|text|content|paragraph|block|heading|title|image|caption)s?\b|\b(?:sample|example) (?:heading|title|paragraph|text|copy|caption|sentence|content|subheading|body)\b|\blipsum\b|\bgreeked\b"),
    ("filler", r"\b(?:insert|add|enter|type|put|paste|place|write) (?:your |the |some |body |more )*(?:an? |more )?(?:short |brief |full |main )?(?:copy|text|content|caption|title|heading|paragraph|body|description|summary|words|quote|image|details|intro\w*)s?\b.*\b(?:here|block|section|space|box|area|later)\b|\breplace (?:this|the|these) (?:paragraph|text|copy|sentence|heading|block|line|words|title)|\b(?:caption|title|text|heading|subtitle|copy|quote|description|name|image|content|body|logo|paragraph) (?:goes )?here\W*$|^(?:heading|title|paragraph|section|subheading|caption|column|item|bullet|block) (?:one|two|three|a|b|\d)\W*$|^(?:button|field|menu|image) (?:label|text|caption|title)\W*$|\byour (?:text|content|copy|title|heading|caption|logo|headline) (?:here|goes)|\blayout only\b|\b(?:type|write|say|add|put) something (?:about|here|for)\b"),
    ("filler", r"\bcoming (?:very )?soon\b|\bunder construction\b(?! sites?\b)|\b(?:content|text|details?|section|copy|page|article|chapter|answer|summary|information|wording|figures?|table|photo|guide|more) (?:is |are )?(?:still )?(?:to come|to follow|pending|to be (?:added|announced|confirmed|supplied|written|completed|provided|advised))\b|^(?:to come|tba|tbc|tbd|to be (?:added|announced|confirmed|supplied|written|completed|provided|advised|determined))\W*$|^(?:text|content|copy|details|section|answer) (?:tba|tbc|tbd|tk)\b|\bnothing (?:here|to see) yet\b|\b(?:will be|being) (?:added|written|published|uploaded) (?:here )?(?:soon|shortly|later)\b|\bwork in progress\b|\bthis (?:page|section|article|guide|text) is (?:not (?:yet )?(?:ready|written|finished)|being (?:written|prepared|updated|built)|incomplete|empty)"),
]
#: The same in Spanish and in Vietnamese with its accents taken off.
NOTICES_OTHER: list[tuple[str, str]] = [
    ("script", r"\b(?:active|activar|activa|habilite|habilitar|habilita|permita|permitir|necesita|requiere|desactivado|desbloquee|encienda)\b.*(?:java\s?script|scripts?)\b|(?:java\s?script|scripts?)\b.*\b(?:desactivad\w|deshabilitad\w|activad\w|necesari\w|bloquead\w|habilitad\w)\b|\b(?:comprobando|verificando)\b.*\bnavegador|\bverifique que (?:es|no es)"),
    ("script", r"\b(?:bat|cho phep|kich hoat|can|yeu cau|tat|mo|chan)\b.*(?:java\s?script|\bscripts?\b)|(?:java\s?script|\bscripts?\b).*\b(?:bi tat|bi chan|de tiep tuc|dang tat|duoc bat)\b|\bdang kiem tra trinh duyet|^hay bat de xem trang|\bxac minh (?:rang )?ban (?:la nguoi|khong phai)"),
    ("error", r"\berror (?:http )?[45]\d\d\b|\b(?:pagina|documento|sitio|servicio|direccion|enlace|recurso|registro|servidor|archivo)\b.*\b(?:no existe|no (?:se )?encontr\w+|no (?:esta )?disponible|ya no existe|ha sido (?:eliminad|movid)\w|no responde|en mantenimiento|fuera de servicio|sobrecargad\w|caducad\w)\b|\bacceso\b.*\b(?:denegado|restringido|prohibido)\b|\bno tiene (?:permisos?|acceso|autorizacion)|\b(?:intentelo|intente|vuelva a intentarlo|vuelva)\b.*\b(?:mas tarde|de nuevo|pronto)\b|\ben mantenimiento\b|\bha ocurrido un error|\bno (?:pudimos|se pudo|hemos podido) (?:encontrar|cargar|conectar|abrir|acceder)|\bdemasiadas (?:solicitudes|peticiones)|\bvolveremos (?:pronto|en breve)"),
    ("error", r"\bloi (?:http )?[345]\d\d\b|\b(?:trang|tai lieu|duong dan|lien ket|he thong|may chu|dich vu|dia chi|tep)\b.*\b(?:khong ton tai|khong tim thay|khong con|da bi (?:go|xoa|chuyen)|bao tri|qua tai|khong kha dung|khong phan hoi|tam ngung|gap loi)\b|\bkhong co quyen (?:xem|truy cap|mo)|\b(?:truy cap|yeu cau)\b.*\b(?:bi tu choi|bi chan)\b|\bvui long (?:quay lai|thu lai)\b|\bthu lai sau\b|\bda xay ra loi|\bqua nhieu yeu cau|\bkhong tim thay trang"),
    ("filler", r"\btexto de (?:ejemplo|relleno|muestra|prueba)|\bproximamente\b\W*|\ben construccion\b|\bcontenido (?:pendiente|en preparacion|de ejemplo|proximamente)|\b(?:inserte|escriba|sustituir|sustituya|reemplace|reemplazar|anada)\b.*\b(?:aqui|antes de publicar|este (?:texto|parrafo))\b|\bpendiente de (?:redaccion|completar|publicar|confirmar)|\bpor (?:definir|confirmar|completar)\W*$|\btitulo de ejemplo"),
    ("filler", r"\b(?:noi dung|bai viet|trang|muc|thong tin)\b.*\b(?:dang (?:duoc )?(?:cap nhat|xay dung|hoan thien|soan)|se (?:duoc )?(?:cap nhat|bo sung|dang)|sap ra mat)\b|\bvan ban mau\b|\bsap ra mat\b|\bdang xay dung\b|\bthay (?:doan|noi dung|van ban) nay\b|\b(?:chen|nhap|dien) (?:noi dung|van ban|tieu de|chu thich)\b.*\b(?:vao day|tai day|o day)\b|\bvan ban (?:gia|thu|vi du)\b|\bdoan van mau\b"),
]

#: Delimiters of template systems, each with what may stand between them.
_NAME = r"[\w.\-]+(?: [\w.\-]+){0,4}"
PLACES: list[tuple[str, str]] = [
    ("{{ }}", r"\{\{\{?\s*[#/^&>!~]?\s*[^{}\n]{0,80}?\s*\}?\}\}"),
    ("{% %}", r"\{%-?[^{}\n]{1,120}?-?%\}"),
    ("<% %>", r"<%[=\-#]?[^<>\n]{1,120}?%>"),
    ("<? ?>", r"<\?(?:php|=)[^\n]{0,120}?\?>"),
    ("${ }", r"\$\{\s*[\w.\- ]{1,60}\s*\}"),
    ("#{ }", r"#\{\s*[\w.\- ]{1,60}\s*\}"),
    ("<< >>", rf"<<\s*{_NAME}\s*>>"),
    ("« »", r"«[a-z][\w.]*(?: [a-z][\w.]*){0,2}»"),
    ("[[ ]]", rf"\[\[\s*{_NAME}\s*\]\]"),
    ("*| |*", r"\*\|[\w:.\- ]{1,60}\|\*"),
    ("@@ @@", r"@@[\w.\-]{1,60}@@"),
    ("% %", r"(?<![\w%])%{1,2}[A-Za-z][A-Za-z_]{1,60}%{1,2}(?![\w%])"),
    ("$ $", r"(?<![\w$])\$[A-Z][A-Z_]{1,60}\$(?![\w$])"),
    ("__ __", r"(?<!\w)__[A-Z][A-Z_]*[A-Z]__(?!\w)"),
    ("## ##", r"(?<![\w#])##?[A-Z][A-Z_]{1,60}##?(?![\w#])"),
    ("{ }", r"(?<![\w$#{\\])\{[A-Za-z_][\w.\-]{0,40}(?: [A-Za-z_]\w*){0,3}\}(?![\w}])"),
    ("[ ] told", r"(?i:\[\s*(?:insert|your|enter|add|type|put|fill in|name of|choose|select|tbc|tbd|tba|todo|xx+|date of|placeholder|inserte|su|indique|chèn|nhập|điền|tên)\b[^\[\]\n]{0,60}\])"),
    ("[ ] name", r"\[(?:[A-Z][A-Z]+(?:[ _.\-][A-Z]+)+|(?:[A-Z]\w*(?:[ _.\-][A-Z]\w*){0,3}))\](?!\()"),
    ("[ ] field", r"(?i:\[(?:(?:first|last|full|company|manager|candidate|client|user|role|job|case|start|end|due|expiry|issue|work|fee|reference|office|contact|employer|street|post|phone|site|state|result|provider|applicant|role)(?:[ _.\-](?:name|title|id|no|number|date|site|amount|address|code|result|state))*|name|date|time|amount|address|state|result|office|client|candidate|company|reference no|phone|email|title|place|city)\](?!\())"),
    ("< > told", r"(?i:<\s*(?:insert|your|enter|add|type|put|name of|inserte|su|indique|chèn|nhập)\b[^<>\n]{1,60}>)"),
    ("<!-- -->", r"(?i:<!--[^<>\n]{0,80}\b(?:here|todo|insert|tbc|tbd|placeholder|your|goes)\b[^<>\n]{0,40}-->)"),
    ("(TBC)", r"(?:\(|\[)\s*(?:TBC|TBD|TBA|TK|TODO|FIXME)\b[^()\[\]\n]{0,60}(?:\)|\])"),
    ("TODO", r"(?<![\w])(?:TODO|FIXME|TBC|TBD|XXX)_[A-Z][A-Z_]*\b|\b(?:TODO|FIXME|XXX)\s*:\s*\S"),
    ("leftover", r"\[object Object\]|(?<![\w'])(?:undefined|NaN)(?![\w'])|(?<![\w'])(?:null|NULL|None|nil)(?=[.,;!]?\s*$)"),
    ("blank line", r"(?<!_)_{4,}(?!_)|\bXX/XX/XX|\bDD/MM/YYYY\b|\bXXXX+\b"),
]
#: Words by which a sentence speaks of markup of any kind, and of that of one delimiter.
TALK = r"syntax|placeholders?|merge (?:fields?|tags?)|template (?:languages?|engines?|variables?|tags?|syntax)|templating|interpolat\w+|delimiters?|(?:curly|double) braces?|(?:square|angle) brackets|markup|escape sequences?"
_TEMPLATES = r"jinja2?|mustache|handlebars|liquid|twig|django|vue|angular|nunjucks|ansible|helm"
TALK_OF: dict[str, str] = {
    "{{ }}": _TEMPLATES,
    "{% %}": _TEMPLATES,
    "<% %>": r"erb|ejs|jsp|asp|rails|underscore\.js",
    "<? ?>": r"php",
    "${ }": r"shell|bash|zsh|environment variables?|export|groovy|maven|terminal|scripts?|commands?|javascript",
    "#{ }": r"ruby|coffeescript|scala|pug",
    "<< >>": r"heredocs?|shell|latex",
    "[[ ]]": r"wikitext|mediawiki|wiki links?|bash|obsidian",
    "% %": r"windows|batch files?|environment variables?|cmd",
    "__ __": r"python|dunder|constants?|macros?",
    "{ }": r"python|f-?strings?|format strings?|json|css|latex|bibtex|routes?",
    "[ ] told": r"markdown|bbcode|wiki",
    "[ ] name": r"markdown|bbcode|wiki",
    "[ ] field": r"markdown|bbcode|wiki",
    "< > told": r"html|xml",
    "<!-- -->": r"html|xml|comments?",
    "TODO": r"linters?|(?:code|todo) comments?",
    "blank line": r"underscores?|date formats?",
}
#: What says of the code before it what it does.
CODE_DOES = r"^[\s`'\"]*(?:prints|outputs|echoes|evaluates to|expands to|renders|stands for|is replaced (?:by|with))\b"
#: How a sentence speaks of what a notice says.
TELLS_OF = r"\b(?:page|message|error|notice|code|status|screen|banner|response|text)s?\b[^.!?]{0,40}?\b(?:says?|said|reads|tells?|told|means?|meant|states?|stated)\b"
#: What programs print.
TRACES = r"Traceback \(most recent call last\)|^\s*(?:at )[\w$.]+\([\w.]+:\d+\)|^\s*File \"[^\"\n]+\", line \d+|^[A-Z]\w*(?:Error|Exception)\b\s*:|\b(?:Warning|Fatal error|Notice|Parse error)\s*:\s*\w+\(?.*\bon line \d+|\{\s*\"(?:error|errors|status|message)\"\s*:|^\s*(?:Incident|Request|Ray|Reference|Trace)(?: ?id)?:?\s*#?[0-9a-f]{6,}\W*$|\bORA-\d{5}\b|\bSQLSTATE\b|\bstack trace\b\s*:|\bsegmentation fault\b"

# --- grammars -----------------------------------------------------------------------------------------------------

_PLACE = re.compile("|".join(f"({p})" for _, p in PLACES))
_TALK = [re.compile(rf"\b(?:{TALK}{'|' + TALK_OF[name] if name in TALK_OF else ''})\b", re.I) for name, _ in PLACES]
_CODE_DOES, _TELLS_OF = re.compile(CODE_DOES), re.compile(TELLS_OF)
_TRACE = re.compile(TRACES, re.M)
_NOTICE = [(f, re.compile(p)) for f, p in NOTICES]
_OTHER = [(f, re.compile(p)) for f, p in NOTICES_OTHER]
_QUOTED = re.compile(r"(?:(?<=^)|(?<=[\s(\[:]))(?:'[^'\n]{1,160}'|\"[^\"\n]{1,160}\"|‘[^’\n]{1,160}’|“[^”\n]{1,160}”|«[^»\n]{1,160}»|`[^`\n]{1,160}`)(?=[\s.,;:!?)\]]|$)")
_FENCE = re.compile(r"^\s*(?:```|~~~).*?^\s*(?:```|~~~)\s*$", re.M | re.S)
_INDENTED = re.compile(r"(?<=\n)(?:[^\S\n]*\n)((?: {4,}|\t)[^\n]*(?:\n|$))+")
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'’”»)]?\s+|\n+")
_WRAP = re.compile(r"(?<=[^\n.!?:|])\n(?=[a-zà-ỹ$(\d])")
_INVISIBLE = re.compile(f"[{''.join(chr(c) for c in range(0x80, 0xFFFF) if unicodedata.category(chr(c)) == 'Cf')}\U000e0000-\U000e007f\U0001d173-\U0001d17a]")


def _grammar_words(grammars: list[tuple[str, str]]) -> set[str]:
    """The words that stand in regular expressions."""
    out: set[str] = set()
    for _, g in grammars:
        g = re.sub(r"\[[^\]]*\]", " ", re.sub(r"\\[a-zA-Z]|\(\?[:!<=]*", " ", g))
        out |= set(re.findall(r"[a-z]{2,}", g.replace("?", "").replace("(s)", "s")))
    return out


_ENDINGS = ("ations", "ation", "ments", "ment", "ings", "ing", "ied", "ies", "ions", "ion", "ors", "or", "ed", "es", "ly", "s", "e", "y")


def stem(word: str) -> str:
    """The word without one ending and without a doubled last letter."""
    for e in _ENDINGS:
        if word.endswith(e) and len(word) - len(e) >= 3:
            word = word[: -len(e)]
            break
    return word[:-1] if len(word) > 3 and word[-1] == word[-2] else word


_STEMS = {stem(w) for w in NOTICE_STEMS | _grammar_words(NOTICES) - ORDINARY}
_OTHER_STEMS = {stem(w) for w in _grammar_words(NOTICES_OTHER)} | FUNCTION_WORDS["es"] | FUNCTION_WORDS["vi"]


@lru_cache(200_000)
def _of_notices(word: str) -> bool:
    return len(word) < 2 or word in FUNCTION_WORDS["en"] or stem(word) in _STEMS


def plain(text: str) -> str:
    """Composed form, without invisible characters, every white space but line breaks as a space."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFC", text))
    return re.sub(r"[^\S\n]+", " ", text.replace("\r\n", "\n").replace("\r", "\n"))


def unaccented(text: str) -> str:
    d = unicodedata.normalize("NFD", text.lower())
    return "".join(c for c in d if not unicodedata.combining(c)).replace("đ", "d")


def without_code(text: str) -> str:
    """The text without fenced blocks and without indented blocks between blank lines that hold no prose."""
    t = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    if "```" in t or "~~~" in t:
        t = _FENCE.sub("\n", t)
    if "\n    " in t or "\n\t" in t:
        t = _INDENTED.sub(lambda m: m.group() if any(len(_WORD.findall(_PLACE.sub("", x))) > 3 for x in m.group().split("\n")) else "\n", t)
    return t


def _dense(at: list[int], most: int, among: int) -> bool:
    """Whether so many of the places lie among so many words."""
    return any(at[i + most - 1] - at[i] < among for i in range(len(at) - most + 1))


def _filler(low: list[str]) -> bool:
    if len(low) < 3:
        return False
    latin = [i for i, w in enumerate(low) if len(w) > 3 and w in LATIN_FILLER]
    if len(latin) >= 3 and (sum(w in LATIN_FILLER for w in low) >= 0.7 * len(low) or _dense(latin, 5, 8)):
        return True
    keys = [i for i, w in enumerate(low) if w in KEYBOARD_FILLER]
    if keys and (len(keys) >= 0.9 * len(low) or _dense([i for i in keys if low[i] not in _PLAIN_KEYS], 6, 6)):
        return True
    return len(low[0]) > 1 and (len(low) >= 4 and len(set(low)) == 1 or len(low[0]) > 2 and all(len(w) > 2 and len(set(w)) == 1 for w in low))


#: Words of the keyboard list that ordinary sentences hold too.
_PLAIN_KEYS = {"text", "testing"}
#: Headings that ask a question about a subject of their own.
_TITLE = re.compile(r"[\W\d]*(?:when|why|how|who|what|where) (?:the|a|an|has|to)\b")
_REPEATED = re.compile(r"\W*(\d{2,}|[a-z]{2,})(?:[ ,;]+\1){3,}\W*", re.I)
#: Other words that a notice may hold, and the share of a long one's words they may be.
FEW_WORDS, FEW_SHARE = 2, 0.08
#: Words of a sentence in Spanish or Vietnamese up to which it is short; of a longer one most must be words of notices.
SHORT_OTHER, DENSE_OTHER = 18, 0.8


def _tells(words: list[str], quotations: int) -> bool:
    """Whether the sentence says more than notices do: too many quotations and words that are neither words of notices nor,
    being capitalised inside the sentence, names."""
    other, most = quotations, max(FEW_WORDS, FEW_SHARE * len(words))
    for i, w in enumerate(words):
        if not _of_notices(w.lower()) and not (i and w[0].isupper()):
            other += 1
            if other > most:
                return True
    return False


def _outside_words(sentence: str, start: int, end: int) -> int:
    return len(_WORD.findall(sentence[:start])) + len(_WORD.findall(sentence[end:]))


def _quoted(sentence: str, start: int, end: int) -> bool:
    """Whether the place lies in a code span beside other words, or in a quotation beside three or more."""
    return any(a < start and end < b and _outside_words(sentence, a, b) >= (1 if sentence[a] == "`" else 3) for a, b in (m.span() for m in _QUOTED.finditer(sentence)))


#: What a template place keeps of its weight of 1 where its sentence speaks of its markup, and where a neighbouring sentence does; the weight from which it counts.
OWN_TALK, NEAR_TALK, LEAST_WEIGHT = 0.25, 0.6, 0.5


def _weight(sentences: list[str], n: int, m: re.Match[str], talking: dict[int, tuple[list[bool], int]]) -> float:
    """What a template place in the n-th sentence weighs in its surroundings. ``talking`` keeps, for each delimiter, which sentences speak of its markup."""
    s, talk = sentences[n], _TALK[m.lastindex - 1]
    if _quoted(s, *m.span()):
        return 0.0
    weight = 1.0
    if _outside_words(s, *m.span()) >= 2 and (talk.search(s, 0, m.start()) or talk.search(s, m.end()) or _CODE_DOES.search(s[m.end() :])):
        weight *= OWN_TALK
    if m.lastindex not in talking:
        of = [bool(talk.search(x)) for x in sentences]
        talking[m.lastindex] = [*of, False], sum(of)  # the last has no next, the first no previous
    of, count = talking[m.lastindex]
    if of[n - 1] or of[n + 1]:
        weight *= NEAR_TALK
    return weight * (1 - (count - of[n]) / max(1, len(sentences) - 1))


def _hints(text: str) -> tuple[list[str], list[str], list[str]]:
    """Of each list of hints those that the text holds at all."""
    low = text.lower()
    return [h for h in _PLACE_HINTS if h in text], [h for h in _TRACE_HINTS if h in text], [h for h in _OTHER_HINTS if h in low]


def residue_in(sentences: list[str], n: int, hints: tuple[list[str], list[str], list[str]], talking: dict[int, tuple[list[bool], int]]) -> str | None:
    """The family of residue in the n-th sentence, or None; ``hints`` are those of the whole text."""
    sentence = sentences[n]
    low = sentence.lower()
    places, traces, others = hints
    if (_MARKS.search(sentence) or places and any(h in sentence for h in places)) and any(_weight(sentences, n, m, talking) >= LEAST_WEIGHT for m in _PLACE.finditer(sentence) if m.group().lower() not in _NO_PLACES):
        return "placeholder"
    if traces and any(h in sentence for h in traces) and _TRACE.search(sentence):
        return "error"
    words = _WORD.findall(sentence)
    if _filler([w.lower() for w in words]) or _REPEATED.fullmatch(sentence):
        return "filler"
    if not _tells(words, sum(_outside_words(sentence, *m.span()) >= 3 for m in _QUOTED.finditer(sentence)) if _QUOTES.search(sentence) else 0):
        low = low.replace("’", "'")
        title, told = _TITLE.match(low), _TELLS_OF.search(low)
        for family, grammar in _NOTICE:
            if (m := grammar.search(low)) and not (title and family == "error") and not (told and told.start() < m.end() - 1) and not _quoted(sentence, *m.span()):
                return family
    if others and any(h in low for h in others):
        bare = unaccented(sentence)
        if len(words) > SHORT_OTHER and sum(w in _OTHER_STEMS or stem(w) in _OTHER_STEMS for w in _WORD.findall(bare)) < DENSE_OTHER * len(words):
            return None
        for family, grammar in _OTHER:
            if (m := grammar.search(bare)) and not _quoted(sentence, *m.span()):
                return family
    return None


_QUOTES = re.compile("['\"‘“«`]")
_MARKS = re.compile(r"[{}<«%$#\[@]|__|\*\|")
_PLACE_HINTS = ("(TB", "(TK", "(TODO", "(FIX", "undefined", "NaN", "null", "NULL", "None", "nil", "TODO", "FIXME", "TBC_", "TBD_", "XX", "DD/MM")
_NO_PLACES = ("[sic]", "[x]", "[ ]", "[...]", "[…]")
_TRACE_HINTS = ("Traceback", "File \"", "Error", "Exception", "on line", "\"error", "\"status", "\"message", "ORA-", "SQLSTATE", "trace", "fault", "Incident", "Request", "Ray", "Reference", "Trace", ".java:", ".js:", ".py:", ".ts:", ".kt:", ".scala:", ".cs:", ".go:", ".rb:")
#: Parts of words of which notices in Spanish and Vietnamese always have one.
_OTHER_HINTS = (
    "script error página pagina acceso permiso navegador mantenimiento disponible existe encontr servicio sitio tarde nuevo pronto solicitudes peticiones conectar cargar texto ejemplo relleno róximamente roximamente construcci contenido inserte aquí aqui publicar "
    "reemplac pendiente definir confirmar completar human lỗi loi trang quyền quyen truy bảo bao quay thử thu trình trinh nội noi bài bai văn van mắt mat xây xay cập cap quá qua tồn ton xác xac đoạn doan chèn chen bật bat"
).split()


def residue_of(text: str | None) -> tuple[str, str] | None:
    """The family and the sentence of the first residue in ``text``, or None."""
    if not text or text.isspace():
        return None
    t = _WRAP.sub(" ", plain(without_code(text)))
    sentences = [s for x in _SENTENCE.split(t) if (s := x.strip())]
    hints, talking = _hints(t), {}
    for n in range(len(sentences)):
        if family := residue_in(sentences, n, hints, talking):
            return family, sentences[n]
    return None


def _residue_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [residue_of(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g and g[0] for g in got], pa.string()), pa.array([g and g[1] for g in got], pa.string())], ["k", "family", "sentence"])


def with_residue(df: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, family, sentence): every row, with the first residue found in its text; nulls where there is none."""
    own = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = own.schema["k"].dataType.simpleString()
    return own.mapInArrow(_residue_batches, f"k {kind}, family string, sentence string").withColumnRenamed("k", key)


def residue_found(df: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The distinct keys of texts with residue."""
    return with_residue(df, text=text, key=key).where("family is not null").select(key).distinct()


def without_residue(df: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text) of the rows without residue; rows with null or empty text are kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([residue_of(t) is None for t in b.column(1).to_pylist()], pa.bool_()))

    own = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = own.schema["k"].dataType.simpleString()
    return own.mapInArrow(run, f"k {kind}, t string").toDF(key, text)
