"""The main body of web pages, by a tree-structured graphical model over their layout.

A record's lines form a tree: a page node, under it the lines; an item of a bulleted run hangs on the line that
introduces the run, any other line on the line before it, by an edge that says whether blank lines part
them. Each line is main body or one of five kinds of furniture. A node potential comes from a log-linear model of
the line's cues, wording, shape and place, an edge potential says how well a parent's kind goes with a child's. Sum-product
message passing, upward then downward, gives each line's exact marginal; lines whose marginal favours furniture go.

Both kinds of potential are trained from labelled pages: a bounded sample of the table (``TRAIN_PAGES``) whose
lines are labelled by high-precision seed rules. Lines without a seed have no label at first; those of which the first model
is sure take part in a second round. Every labelled line is learned twice, with and without its cues, so wording, shape, place and
neighbours tell also lines that no list knows. Only the
weights leave the driver, and their number is fixed. Inference is one pass over Arrow batches without a shuffle,
vectorised over all pages of a batch, level by level of their trees.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.samples import least_hashed

#: Labelled pages: at most so many records, those of least hash.
TRAIN_PAGES = 3000
#: Words of a sentence from which it is main body for sure, and the marginal from which a line without a seed takes part in the second round.
SURE_WORDS, SURE = 5, 0.9
#: Weight of a cue for its kind before training, and what a line learned without its cues counts.
PRIOR, HIDDEN = 6.0, 0.3
#: A box of links is its head and the related lines below it: apart, so that edges tell that links begin below a head.
KINDS = ["main", "menu", "notice", "related", "edge", "head"]
MAIN, MENU, NOTICE, RELATED, EDGE, HEAD = range(6)
HASHED = 4096
EDGES = ["next", "gap", "item"]
LINK_MARKS = ("›", "»", "▸")

# --- fixed values: words of page furniture in English, Vietnamese and Spanish --------------------------------------

MENU_WORDS = set(
    """home|about|about us|services|support|pricing|faqs|faq|sign up|start now|guides|training|menu|our team|contact|contact us|search|employers|individuals|volunteers|locations|
    help centre|help center|help|media|media room|blog|news|events|resources|industries|partners|careers|case studies|webinars|forms|language|my account|account|log in|login|sign in|track my check|accessibility|entrar|salir|tarifas|empresas|voluntarios|nosotros|trang nhất|doanh nghiệp|thoát|    site map|sitemap|terms|privacy|complaints|cookies|legal|products|solutions|shop|store|company|team|press|community|docs|documentation|dashboard|register|logout|log out|subscribe|topics|categories|archive|downloads|
    trang chủ|dịch vụ|hướng dẫn|hỗ trợ|tin tức|bảng giá|giới thiệu|liên hệ|đăng nhập|đăng ký|tuyển dụng|biểu mẫu|tìm kiếm|điều khoản|bảo mật|sơ đồ trang|sự kiện|đối tác|tài khoản|câu hỏi thường gặp|ngôn ngữ|đào tạo|
    inicio|servicios|guías|ayuda|registro|noticias|quiénes somos|precios|buscar|contacto|iniciar sesión|acceso|empleo|formularios|eventos|recursos|socios|idioma|mi cuenta|términos|privacidad|mapa del sitio|blog|prensa|preguntas frecuentes|acceder|formación""".replace("\n", "").split("|")
)
MENU_WORDS = {w.strip() for w in MENU_WORDS}
BUTTONS = {w.strip() for w in """accept all|accept|accept cookies|allow all|allow selection|reject all|reject optional|reject|decline|cookie settings|manage preferences|preferences|i agree|agree|got it|ok|save and close|save settings|only necessary|necessary only|customise|customize|
    aceptar todo|aceptar|rechazar|rechazar todo|solo necesarias|configurar|configuración|personalizar|guardar|preferencias|entendido|
    đồng ý|chấp nhận|chấp nhận tất cả|từ chối|tùy chỉnh|cài đặt|chỉ cần thiết|chỉ cookie cần thiết|đã hiểu|lưu lựa chọn""".replace("\n", "").split("|")}  # fmt: skip
RELATED_HEADS = {w.strip() for w in """you may also like|on other pages|latest updates|related reading|most viewed this week|most viewed|readers also opened|trending guides|explore more|in this section|related articles|related pages|related guides|more on this topic|recommended for you|see also on this site|popular guides|read next|more from us|you might also like|keep reading|popular now|most read|recommended reading|what others read|further reading on this site|
    bài liên quan|có thể bạn quan tâm|xem nhiều nhất|đọc thêm|bài viết khác|tin liên quan|bài mới nhất|trong mục này|xem thêm|
    también le puede interesar|artículos relacionados|lo más leído|lecturas relacionadas|más leídos|le puede interesar|otras guías|últimas noticias|en esta sección|lo más visto|seguir leyendo|contenido relacionado""".replace("\n", "").split("|")}  # fmt: skip

#: What lines of the other kinds of furniture say.
CUES: dict[str, str] = {
    "skip": r"^(?:skip|jump) to (?:the )?(?:main )?(?:content|navigation|menu)|^back to (?:the )?top|^return to top|^(?:saltar|ir) al contenido|^volver arriba|^chuyển đến nội dung|^về đầu trang|^lên đầu trang",
    "pager": r"^previous (?:article|page|guide|post)\b|\bnext (?:article|page|guide|post)$|^page \d+ (?:of|/) \d+|^trang \d+ ?/ ?\d+|^página \d+ de \d+|^(?:artículo )?anterior\b.*\bsiguiente|^bài trước\b|^bài tiếp",
    "byline": r"^(?:written|reviewed|edited|prepared|posted|published|updated|checked|approved|compiled|words|text|author|story)\s*(?:by|:)\s|^by (?:the )?\S.{0,60}\b(?:writers?|editors?|desk|team|staff|panel|authors?|group)\b|^by [A-Z]\w+ [A-Z]\w+$|\bcontent panel\b|\beditorial (?:desk|team|staff)\b|\bpolicy writers\b|^last (?:reviewed|updated|checked|modified)\b|^(?:published|updated|reviewed|posted)(?: on)?\b[^.]{0,24}\d{4}|^version \d|\bweb team$|^redacción de|^(?:escrito|revisado|actualizado|publicado) (?:por|el)\b|^(?:última|ultima) (?:revisión|actualización)|^biên soạn (?:bởi|:)|^(?:tác giả|người viết|cập nhật|biên tập|đăng ngày|rà soát)\b.{0,60}$|^por (?:el|la) (?:equipo|redacción)",
    "reading": r"^(?:reading time|read time|time to read)\b|^\d+[- ]min(?:ute)?s? read\b|^lectura de \d|^tiempo de lectura|^thời gian đọc",
    "share": r"^share\b[ :|]|^share$|^(?:share|print|save)(?:\s*[|/·-]\s*(?:share|print|save|email.*|copy link|bookmark))+|^copy\s+(?:the )?\s*link\b|\bshare (?:this|it) (?:with|on|by|guide|page|article)|^(?:send|email|forward|pass) (?:this|it)\b.{0,30}\bto (?:a|your|someone)\b|^liked this|^(?:comparta|compartir|comparte)\b|^chia sẻ\b|^imprimir\b|^in bài|^gửi (?:bài|trang) này|^envíe esta",
    "legal": r"©|^copyright\b|\ball rights reserved|\blicen[cs]e no\.?|\bpty\b|\bterms of use\b|\bis not legal advice|\bgeneral information\b|\bneeds? (?:our )?(?:written )?permission\b|^republish\w*|^nothing\b.{0,12}\bon\b.{0,12}\bthis\b.{0,12}\bsite\b|^bản quyền|\bchỉ mang tính tham khảo|\bno es asesor[ií]a|^derechos reservados|\btodos los derechos|\bmember agencies\b|\backnowledges (?:its|the)\b|^disclaimer\b|\bbusiness number\b|\babn \d|\bkhông thay (?:cho )?tư vấn|^mã số doanh nghiệp|^(?:giấy phép|mst)\b|^(?:abn|acn|nif|cif)\b",
    "contact": r"^(?:call|phone|tel|telephone|hotline|fax|email|teléfono|tổng đài|điện thoại|llame|gọi)\b[ :].{0,40}\d|^level \d+,|^\d+ \w+ (?:street|road|avenue|lane)\b|\bstreet, [A-Z]\w+$|^(?:suite|unit|floor|tầng|piso|planta) \d+|^(?:calle|avenida|đường|số) .{0,40}\d",
    "feedback": r"\bwas this (?:page|guide|article|information) (?:helpful|useful)|\bpeople voted|^rate this\b|\btell us what you think\b|\bfeedback (?:about|on) this\b|^(?:take|complete|fill in) our\b.{0,30}\bsurvey|\bsurvey\b.{0,20}$|^report a problem|^(?:did you find|how useful|help us improve)\b|^(?:le resultó|fue útil|le ha sido útil|¿le|valore esta|valora esta|danos tu opinión|envíe sus comentarios)|^(?:trang này có hữu ích|bài viết này có hữu ích|đánh giá trang|đánh giá bài|góp ý|cho chúng tôi biết)",
    "signup": r"^(?:join|subscribe|sign up|register)\b.{0,60}\b(?:readers|bulletin|newsletter|email|updates|list)\b|\benter your email\b|\b(?:free )?(?:checklist|guide|updates|news|alerts) by email\b|\bmonthly bulletin\b|\bnewsletter\b|^(?:suscríbase|suscribirse|reciba|regístrese|únase)\b|^(?:đăng ký nhận|nhận tin|nhận bản tin|để lại email)|\bboletín\b",
    "ask": r"^(?:need|want) help\?|\bchat (?:with us|now|to)\b|^start your\b.{0,50}\b(?:online|with|check|today)|^(?:get|order|book|begin|apply for|request) (?:your|a|an)\b.{0,40}\b(?:today|now|online|quote|demo)\b|^(?:download|get|try) (?:the|our)\b.{0,50}\bapp\b|^follow\b.{0,60}\b(?:social|channels|facebook|linkedin|instagram|us)\b|^(?:find|like|join) us on\b|^(?:advertisement|advertising|ad|sponsored|promoted|publicidad|anuncio|quảng cáo|patrocinado|tài trợ)\b|^website by\b|^(?:powered|built|hosted|designed) by\b|^(?:solicite|empiece|comience|inicie|descargue|pida|síganos|siga a|hable con|chatee|haga su)\b.{0,70}$|^(?:bắt đầu|tải ứng dụng|theo dõi|trò chuyện|đặt|nhận báo giá|tải app|cần giúp|bạn cần hỗ trợ|bạn cần giúp|làm kiểm tra)\b.{0,70}$|^¿necesita ayuda|^(?:sitio|web) (?:por|de)\b|^(?:trang web|thiết kế) (?:bởi|của)\b|\bfree for \d+ days\b|^(?:popular |related )?(?:tags|topics|keywords|categories)\b ?:|^(?:etiquetas|temas|thẻ|từ khóa)\b ?:|^speak to (?:our|an?)\b",
}
_HEAD = re.compile(r"^(?:more (?:from|on|about|in)|related|see also|also on|others? (?:read|also)|further reading|más (?:de|sobre|en)|otros? artículos|thêm (?:từ|về)|khác từ)\b[^.]{0,60}$", re.I)
_COOKIE = r"\bcookies?\b|\btracking files\b|\b(?:partner|first-party) (?:and partner )?tags\b|\bstorage on this\b|\bsmall files\b|\bconsent record\b|\btệp nhỏ\b|\balmacena\w* (?:archivos|datos)|\bpixels?\b|\blocal storage\b|\btệp theo dõi\b|\barchivos (?:pequeños|en su)"
_OURS = r"\b(?:we|our|us|you|your|this (?:site|website|page)|its partners|its suppliers|sus socios|su (?:dispositivo|navegador|consentimiento)|usted|usamos|utilizamos|este sitio|esta (?:web|página)|nuestr\w+|acepta|chúng tôi|của bạn|bạn|đối tác|trang (?:này|web)|sets|set)\b"

# --- shapes and features ---------------------------------------------------------------------------------------------

_CUES = [(n, re.compile(p, re.I)) for n, p in CUES.items()]
_COOKIE_RE, _OURS_RE = re.compile(_COOKIE, re.I), re.compile(_OURS, re.I)
_MARK = re.compile(r"^\s*(?:([-*•›»▸▪‣–])|(\d{1,2}[.)])|(\[[ xX]?\])|(#{1,6})|(>))\s+(?=\S)")
_STOP = re.compile(r"[.!?:;…。][\"'”’»)\]]*$")


def _only(words: set[str]) -> re.Pattern[str]:
    """Lines made of nothing but these words and what parts them."""
    one = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
    return re.compile(rf"\W*(?:{one})(?:\W+(?:{one}))*\W*", re.I)


_ALL_MENU, _ALL_BUTTONS = _only(MENU_WORDS), _only(BUTTONS)
_COOKIE_HINTS = ("cookie", "track", "tags", "storage", "small files", "consent record", "tệp", "almacena", "archivos", "pixel")
_EDGE = re.compile("|".join(f"(?:{p})" for p in CUES.values()), re.I)
_WORDS, _DIGIT = re.compile(r"[^\W\d_]+"), re.compile(r"\d")
#: Words of a title below which each of its words counts.
SHORT_TITLE = 5
_CRUMB = re.compile(r"\s+[>»›/|·]\s+")


def normal(line: str) -> str:
    return re.sub(r"\s+", " ", line).strip()


def cues_of(line: str, bare: str, stop: bool, count: int) -> list[str]:
    """The furniture cues of a line."""
    out = []
    small = bare.lower()
    if count <= 40 and not (stop and count > 6):
        low = small.rstrip(" .:!")
        if low in RELATED_HEADS or _HEAD.match(bare):
            out.append("head")
        elif _ALL_MENU.fullmatch(bare):
            out.append("menu")
        elif _ALL_BUTTONS.fullmatch(bare):
            out.append("button")
        elif len(crumbs := _CRUMB.split(line)) >= 2 and crumbs[0].strip().lower() in MENU_WORDS and all(len(p) < 26 for p in crumbs[:-1]):
            out.append("crumb")
    if any(h in small for h in _COOKIE_HINTS) and _COOKIE_RE.search(bare):
        out.append("cookie+" if _OURS_RE.search(bare) else "cookie-")
    if (count <= 14 or count <= 24 and not stop) and _EDGE.search(bare):
        out += [n for n, p in _CUES if p.search(bare)]
    return out


class Line:
    """One non-blank line: its number, wording, cues and shape, and whether blank lines stand before it."""

    __slots__ = ("no", "text", "cues", "title", "mark", "gap", "words", "stop", "told", "base")

    def __init__(self, no: int, raw: str, gap: bool):
        self.no, self.gap = no, gap
        self.text, self.cues, self.title, self.mark, self.words, self.stop, self.told, self.base = _parts_of(raw)

    @property
    def slots(self) -> list[int]:
        return self.told + self.base


@lru_cache(200_000)
def _parts_of(raw: str) -> tuple:
    text = normal(raw)
    m = _MARK.match(text)
    mark = next(("#" if g[0] == "#" else "n" if g[0].isdigit() else g[0]) for g in m.groups() if g) if m else ""
    bare = text[m.end() :] if m else text
    words = [w.lower() for w in _WORDS.findall(bare)]
    stop = bool(_STOP.search(text[-12:]))
    cues = cues_of(text, bare, stop, len(words))
    title = not stop and len(words) <= 18 and "|" not in text
    return text, cues, title, mark, words, stop, _cue_slots(cues, words), _base_slots(text, title, mark, words, stop)


def lines_of(text: str | None) -> list[Line]:
    """The non-blank lines, parted at LF and numbered from 0."""
    out, gap = [], False
    for no, raw in enumerate((text or "").split("\n")):
        if raw.strip():
            out.append(Line(no, raw, gap))
            gap = False
        else:
            gap = True
    for i, x in enumerate(out):
        x.base = [*x.base, _slot(f"top:{min(i, 3)}"), _slot(f"end:{min(len(out) - 1 - i, 3)}")]
    return out


def parents_of(lines: list[Line]) -> list[tuple[int, int]]:
    """For each line its parent's place (-1: the page) and the kind of edge."""
    out: list[tuple[int, int]] = []
    intro = -1
    for i, x in enumerate(lines):
        bullet = x.mark in ("-", "*", "•", "›", "»", "▸", "▪", "‣", "–", "n", "[") and bool(x.mark)
        if not i:
            out.append((-1, 0))
        elif bullet:
            if not lines[i - 1].mark or lines[i - 1].mark == "#":
                intro = i - 1
            out.append((intro if intro >= 0 else i - 1, 2))
        else:
            intro = -1
            out.append((i - 1, 1 if x.gap else 0))
    return out


@lru_cache(300_000)
def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) % HASHED


def _size(n: int) -> int:
    return n if n < 3 else 3 if n < 7 else 7 if n < 12 else 12 if n < 20 else 20


def _cue_slots(cues: list[str], words: list[str]) -> list[int]:
    """Slots of what the lists say of a line."""
    f = [f"c:{c}" for c in cues] or ["c:"]
    if cues and "cookie-" not in cues:
        f.append(f"n+:{_size(len(words))}")
    return [_slot(k) for k in f]


def _base_slots(text: str, title: bool, mark: str, words: list[str], stop: bool) -> list[int]:
    """Slots of the line's wording and shape, whatever the lists say. Longer lines that could be a heading or a teaser alike
    give little wording, so that their neighbours decide."""
    n = len(words)
    f = [f"m:{mark}", f"n:{_size(n)}", f"shape:{stop}{title}{bool(mark)}", f"bar:{'|' in text}{bool(_DIGIT.search(text))}"]
    if title:
        lead = text.lstrip("-*•›» ")[:1]
        f += [f"title:{mark}:{lead.isupper()}", f"e:{words[-1] if words else ''}", f"b:{' '.join(words[:2])}", f"low:{lead.islower()}"]
    if n < (SHORT_TITLE if title else 30):
        f += [f"w:{w}" for w in words]
        if not title:
            f += [f"b:{' '.join(words[:2])}", f"e:{words[-1] if words else ''}"]
    return [_slot(k) for k in f]


def seed_labels(lines: list[Line]) -> list[int | None]:
    """Labels of the lines that the seed rules are sure of: lines with a cue, lines directly below the head of a box,
    sentences without a cue, and lines without a cue that lead to such a sentence or go on from it. None for the rest: lines between furniture, and what looks like a link."""
    out: list[int | None] = []
    related = False
    for x in lines:
        c = x.cues
        label: int | None = None
        if "head" in c:
            label, related = HEAD, True
        elif "menu" in c or "crumb" in c or "skip" in c:
            label, related = MENU, False
        elif "button" in c or "cookie+" in c:
            label, related = NOTICE, False
        elif c and "cookie-" not in c and not (x.stop and len(x.words) > 14):
            label, related = EDGE, False
        elif related and x.title and not x.mark == "#":
            label = RELATED
        else:
            related = False
            if x.mark == "#" or x.stop and len(x.words) >= SURE_WORDS:
                label = MAIN
        out.append(label)
    # what leads to main body, over a byline or the like, or goes on from it, is main body, unless it looks like a link
    free = [label is None and not x.cues and x.mark not in LINK_MARKS for x, label in zip(lines, out)]
    for at in (range(len(lines) - 1, -1, -1), range(len(lines))):
        near = None
        for i in at:
            if free[i] and out[i] is None and near == MAIN:
                out[i] = MAIN
            if out[i] != EDGE or at.step > 0:
                near = out[i]
    return out


# --- training -----------------------------------------------------------------------------------------------------


class Model:
    """Node weights (slots x kinds), log prior, edge log potentials (edges x parent x child) and page prior."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, edges: np.ndarray, first: np.ndarray, cues: bool = True):
        self.weights, self.bias, self.edges, self.first, self.cues = weights, bias, edges, first, cues


def _prior() -> np.ndarray:
    """Node weights before anything is learned: a cue speaks for the kind that it labels."""
    w = np.zeros((HASHED, len(KINDS)))
    kinds = {"head": HEAD, "menu": MENU, "crumb": MENU, "skip": MENU, "button": NOTICE, "cookie+": NOTICE}
    for cue in [*kinds, *(c for c in CUES if c not in kinds)]:
        w[_slot(f"c:{cue}"), kinds.get(cue, EDGE)] = PRIOR
    return w


def _fit_nodes(examples: Counter, w: np.ndarray, b: np.ndarray, rounds: int, rate: float, prior: np.ndarray) -> None:
    """Gradient steps, in place, on (slots, label) with their counts."""
    k = len(KINDS)
    y, count = np.eye(k)[[label for _, label in examples]], np.sqrt(np.array(list(examples.values()), float))[:, None]
    lengths = np.array([len(slots) for slots, _ in examples])
    ids = np.concatenate([np.array(slots) for slots, _ in examples])
    starts, of = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(lengths)), lengths)
    seen = np.full((HASHED, 1), 1e-3)
    for _ in range(rounds):
        p = np.add.reduceat(w[ids], starts, axis=0) + b
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = ((y - p) * count)[of]
        grad = np.stack([np.bincount(ids, g[:, j], HASHED) for j in range(k)], 1) - 0.2 * (w - prior)
        seen += (grad**2).mean(1, keepdims=True)
        w += rate * grad / np.sqrt(seen)


def train(texts: list[str | None], rounds: int = 40, rate: float = 0.5, cues: bool = True) -> Model:
    """Fit node weights by gradient steps on labelled lines and edge potentials by smoothed counts.

    The second round adds the lines without a seed of which the first model is sure. Without ``cues``, seeds only label: no cue is a feature."""
    k = len(KINDS)
    pages = [p for p in map(lines_of, texts) if p]
    seeds = [seed_labels(p) for p in pages]
    prior = _prior()
    w, b = prior.copy(), np.zeros(k)
    model = Model(w.astype(np.float32), b, np.zeros((len(EDGES), k, k)), np.zeros(k), cues)
    for steps in (rounds, rounds // 2):
        examples, pair, first = Counter(), np.full((len(EDGES), k, k), 0.2) + np.eye(k), np.ones(k)  # without examples kinds stay together
        pair[:, HEAD, RELATED] += 5  # and links come below a head
        for lines, labels in zip(pages, seeds):
            for i, (x, (p, e)) in enumerate(zip(lines, parents_of(lines))):
                if labels[i] is None:
                    continue
                if cues:
                    examples[tuple(x.slots), labels[i]] += 1
                examples[tuple(x.base), labels[i]] += HIDDEN if cues else 1
                if p < 0:
                    first[labels[i]] += 1
                elif labels[p] is not None:
                    pair[e, labels[p], labels[i]] += 1
        if not examples:
            break
        share = np.bincount([label for labels in seeds for label in labels if label is not None], minlength=k) + 1.0
        share /= share.sum()
        b[:] = np.log(share)
        _fit_nodes(examples, w, b, steps, rate, prior)
        model = Model(w.astype(np.float32), b, np.log(pair / pair.sum(2, keepdims=True)) - np.log(share), np.log(first / first.sum()) - np.log(share), cues)
        if steps == rounds:
            got = marginals(model, pages)
            seeds = [[int(m[i].argmax()) if s is None and m[i].max() >= SURE else s for i, s in enumerate(labels)] for labels, m in zip(seeds, got)]
    return model


# --- inference ----------------------------------------------------------------------------------------------------


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def marginals(model: Model, pages: list[list[Line]]) -> list[np.ndarray]:
    """Of each page the kinds' marginals of its lines: messages go up from the deepest level of all trees, then down."""
    ids, starts, parent, edge, depth, sizes = [], [], [], [], [], []
    base = 0
    for lines in pages:
        own: list[int] = []
        for x, (p, e) in zip(lines, parents_of(lines)):
            starts.append(len(ids))
            ids += x.slots if model.cues else x.base
            parent.append(base + p if p >= 0 else -1)
            edge.append(e)
            own.append(own[p] + 1 if p >= 0 else 0)
        depth += own
        sizes.append(len(lines))
        base += len(lines)
    k = len(KINDS)
    if not base:
        return [np.zeros((0, k)) for _ in pages]
    node = np.add.reduceat(model.weights[np.array(ids)], np.array(starts), axis=0) + model.bias
    node -= _logsum(node, 1)[:, None]
    par, edg, dep = np.array(parent), np.array(edge), np.array(depth)
    belief = np.where((par < 0)[:, None], node + model.first, node)
    up = np.zeros((base, k))  # what each line tells its parent
    order = np.argsort(dep, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(dep))[:-1])
    for at in reversed(levels[1:]):
        m = _logsum(model.edges[edg[at]] + belief[at][:, None, :], 2)
        m -= m.max(1, keepdims=True)
        up[at] = m
        np.add.at(belief, par[at], m)
    for at in levels[1:]:
        out = belief[par[at]] - up[at]  # what the parent knows without this child
        m = _logsum(model.edges[edg[at]] + out[:, :, None], 1)
        belief[at] += m - m.max(1, keepdims=True)
    belief -= _logsum(belief, 1)[:, None]
    return np.split(np.exp(belief), np.cumsum(sizes)[:-1])


def _infer_batches(model: Model, want: str, block: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, block):
                part = b.slice(start, block)
                texts = part.column(1).to_pylist()
                pages = [lines_of(t) for t in texts]
                got = marginals(model, pages)
                if want == "body":
                    out = []
                    for t, lines, m in zip(texts, pages, got):
                        gone = {x.no for x, r in zip(lines, m) if r[MAIN] < 0.5}
                        out.append(None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone).strip("\n"))
                    # 128 bits for the key and whole text, which tell deliveries of one record
                    ids = [xxhash.xxh128_intdigest(repr((k, t))) for k, t in zip(part.column(0).to_pylist(), texts)]
                    halves = [pa.array([(x >> at & 2**64 - 1) - 2**63 for x in ids], pa.int64()) for at in (0, 64)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string()), *halves], ["k", "body", "r1", "r2"])
                else:
                    rows = [(i, x.no, KINDS[1 + int(r[1:].argmax())]) for i, (lines, m) in enumerate(zip(pages, got)) for x, r in zip(lines, m) if r[MAIN] < 0.5]
                    at, no, kind = zip(*rows) if rows else ((), (), ())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(kind, pa.string())], ["k", "line_no", "kind"])

    return run


def labelled_sample(df: DataFrame, *, text: str = "text", key: str = "chunk_id", most: int = TRAIN_PAGES) -> list[str]:
    """Texts of at most ``most`` records, those of least hash."""
    return [r.t for r in least_hashed(df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null"), most, 3)]


def fit(df: DataFrame, *, text: str = "text", key: str = "chunk_id", most: int = TRAIN_PAGES) -> Model:
    return train(labelled_sample(df, text=text, key=key, most=most))


def furniture_lines(df: DataFrame, *, text: str = "text", key: str = "chunk_id", model: Model | None = None) -> DataFrame:
    """(key, line_no, kind) of the distinct non-blank lines that are not main body.

    Null and blank texts give nothing. Records delivered again come once; a key with several texts gives the lines of each. Each text is its own tree, whatever its length; other columns are ignored.
    """
    m = model or fit(df, text=text, key=key)
    own = df.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t")).where("t is not null")
    return own.mapInArrow(_infer_batches(m, "lines"), "k string, line_no int, kind string").distinct().withColumnRenamed("k", key)


def main_body(df: DataFrame, *, text: str = "text", key: str = "chunk_id", model: Model | None = None) -> DataFrame:
    """(key, body): of each distinct key and text, the text with only its main body; null texts stay null, all furniture gives an empty body."""
    m = model or fit(df, text=text, key=key)
    own = df.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t"))
    got = own.mapInArrow(_infer_batches(m, "body"), "k string, body string, r1 bigint, r2 bigint")
    return got.dropDuplicates(["r1", "r2"]).select(F.col("k").alias(key), "body")
