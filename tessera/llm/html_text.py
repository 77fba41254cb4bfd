"""Main-text extraction from HTML with two-pass block rules."""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_steps

# Frequent function words by language.
STOP_WORDS = {
    "en": "a about after again against all also although among an and another any are around as at be because been "
          "before being between both but by can could did do does down during each either even ever every few for from "
          "further had has have he her here him his how i if in into is it its just last least less like made make "
          "many may me might more most much must my no nor not now of off on once one only or other our out over own "
          "per said same she should since so some still such than that the their them then there these they this "
          "those though through to too two under until up upon us very was we were what when where which while who "
          "whom whose why will with within without would year years yet you your",
    "de": "ab aber alle allem allen aller alles als also am an andere anderen auch auf aus bei beim bereits bis da damit "
          "dann das dass dem den denn der des dessen die dies diese diesem diesen dieser dieses doch dort du durch ein "
          "eine einem einen einer eines er erst es etwa für gegen habe haben hat hatte hatten hier ich ihm ihn ihr ihre "
          "ihrem ihren ihrer im immer in ins ist ja jede jeder jedoch jetzt kann kein keine können man mehr mein mit "
          "muss nach nicht noch nun nur ob oder ohne schon sehr sei sein seine seinem seinen seiner seit sich sie sind "
          "so sollen sondern über um und uns unter vom von vor war waren was weil wenn werden wie wieder will wir wird "
          "wo worden wurde wurden zu zum zur zwischen",
    "fr": "à ai ainsi alors après au aucun aussi autre autres aux avaient avait avant avec avoir c ce cela celle celui "
          "ces cet cette ceux chez comme contre d dans de depuis des deux dont du elle elles en encore entre est et "
          "étaient était été être eu eux fait faire faut il ils j je jusqu l la le les leur leurs lors lui m ma mais "
          "même moins mon n ne ni nos notre nous on ont ou où par pas pendant peu peut plus pour qu quand que qui s sa "
          "sans se sera ses si son sont sous sur tous tout toute toutes très trois un une vers vous y",
    "es": "a al algo además ahora ante antes aquí así aunque cada casi como con contra cual cuando de del desde después "
          "donde dos durante e el él ella ellas ellos en entre era eran es esa ese eso esta está están este esto estos "
          "fue fueron ha había han hasta hay la las le les lo los más me mi mientras mismo muy ni no nos o otra otro "
          "otros para pero poco por porque que qué quien se sea ser si sí sido sin sobre son su sus también tan tanto "
          "tiene todo todos tras tu un una uno unos y ya yo",
    "it": "a ad agli ai al alla alle allo anche ancora avere c che chi ci come con contro cui da dal dalla dalle degli dei "
          "del dell della delle dello di dopo dove due e è ed era erano fra gli ha hanno i il in io l la le lei lo loro "
          "lui ma mentre molto nei nel nell nella nelle non nostro o ogni per perché però più poi prima quando quanto "
          "quella quello questa questo se senza si sia sono stata stato su sua sue sugli sul sulla suo tra tutti un una uno",
    "pt": "a à ainda ao aos após as às até com como contra da das de depois do dos e é ela ele eles em entre era essa esse "
          "esta está este eu foi foram há isso já lhe mais mas mesmo muito na nas não nem no nos o os ou para pela pelas "
          "pelo pelos por porque quando que quem se sem ser seu seus sobre sua suas também tem um uma",
    "nl": "aan al alle als bij daar dan dat de den der deze die dit door een en er ge haar had heb heeft het hij hoe hun ik "
          "in is je kan maar meer met mijn na naar niet nog nu of om omdat onder ook op over te tegen toen tot uit van "
          "veel voor want was wat we wel werd werden wie wordt zal ze zich zij zijn zo zou",
    "pl": "a ale bardzo być był była było były co czy dla do dla gdy go i ich ile im inne jak jako je jednak jego jej jest "
          "już kiedy która które którego której który którzy ma może na nad nie nich niż o od oraz po pod podczas ponad "
          "przed przez przy roku są się tak także tego tej ten to tylko tym u w we więc z za zaś ze że",
    "ru": "а без более был была были было быть в вам вас во вот все всех вы где да для до его ее если есть еще же за и из "
          "или им их к как когда которая которые который ли мы на над не него нет но ну о об он она они от по под после "
          "при про с со так также там то только у уже что чтобы это этого этой этот я",
    "sv": "af alla att av bara blev blir då de dem den denna där det detta dig din du efter ej eller en ett för från ha hade "
          "han har hon hos hur i icke in inte jag kan kom kunde man med mellan men mig min mot mycket när ni nu och om "
          "oss på så sig sin ska som till under upp ut var vi vid vill än är över",
}
# Elements whose content is no running text, and elements without content.
RAW = {"script", "style", "title", "noscript", "template", "iframe", "textarea", "svg", "math", "canvas",
       "object", "audio", "video", "select", "option", "button", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Elements that end a block, zones that are never article text, zones that are.
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div",
         "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
         "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search",
         "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
BOILER = {"nav", "footer", "aside", "menu", "dialog", "search", "head"}
MAIN = {"article", "main"}
# Words in class, id or role that name such zones.
BOILER_NAMES = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment",
                "comments", "commentlist", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus",
                "footer", "gdpr", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination",
                "popup", "promo", "promoted", "related", "replies", "respond", "share", "sharing", "sidebar", "social",
                "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
# Those of them that also name the layout around an article.
LAYOUT_NAMES = {"banner", "complementary", "contentinfo", "footer", "form", "menu", "nav", "navbar", "navigation", "notice",
                "share", "sharing", "sidebar", "social", "toolbar", "widget"}

# Elements of the head, and pairs of a start tag and the open elements it ends, up to a border.
HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "thead": ({"tr", "thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"tr", "thead", "tbody", "tfoot"}, {"table"}),
        "tfoot": ({"tr", "thead", "tbody", "tfoot"}, {"table"})}
# Of the elements without running text, those that run to the page's end if nothing ends them.
TO_THE_END = {"script", "style", "title", "noscript", "iframe", "textarea", "xmp", "noembed", "noframes"}
# Those that never hold another: with a second one first, the end tag is missing.
ENDED_BY_NEXT = {"button", "select", "audio", "video"}
OPTION_END = re.compile(r"</option\b[^<>]*>|(?=</?(?:option|optgroup|datalist|select)\b)", re.I)
RAW_END = {n: re.compile(rf"</{n}\b[^<>]*>" + (rf"|(?=<{n}\b)" if n in ENDED_BY_NEXT else ""), re.I)
           for n in RAW - {"option"}} | {"option": OPTION_END}

# A tag ends before the next < outside quotes, and no attempt goes back: what is no tag costs no
# more than its own length, however often < comes.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)"
                   r"((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NAME_PART = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rules:
    """Thresholds: characters, and shares of words or characters."""

    short: int = 70
    long: int = 200
    stop_low: float = 0.10
    stop_high: float = 0.20
    stop_fit: float = 0.15
    link_share: float = 0.2
    main_link_share: float = 0.8
    heading_reach: int = 200
    layout_share: float = 0.25
    article_share: float = 0.25


@dataclass(eq=False)
class Named:
    """An element with a boilerplate name, or a form: whether its text goes shows when the
    whole page is read. ``own`` is the running text in it, ``inside`` also that of named
    elements in it."""

    token: str
    outer: Named | None
    own: int = 0
    inside: int = 0
    gone: bool | None = None


@dataclass
class Block:
    text: str
    linked: int
    zone: str
    heading: bool
    named: Named | None = None
    label: str = ""

    def running(self, rules: Rules) -> int:
        """Its characters, if it reads like running text."""
        return len(self.text) if len(self.text) >= rules.short and self.linked <= rules.link_share * len(self.text) else 0


def _zone(name: str, attributes: str, inside_main: bool) -> tuple[str, str]:
    """What an element does to the text in it: ``boiler``, ``named`` (by the name part that
    comes second), ``main`` or nothing."""
    token = "form" if name == "form" else ""
    if attributes.strip():
        for key, value in ATTRIBUTE.findall(attributes):
            key = key.lower()
            if key == "hidden" or key == "aria-hidden" and "true" in value:
                return "boiler", ""
            if key == "style" and re.search(r"display\s*:\s*none", value):
                return "boiler", ""
            if key in ("class", "id", "role") and name not in ("body", "html", "main") and not (name == "article" and key != "class"):
                parts = BOILER_NAMES.intersection(NAME_PART.findall(value.lower()))
                # a name of content counts before one of layout
                if parts:
                    token = min(parts, key=lambda t: (t in LAYOUT_NAMES, t)) if not token or token in LAYOUT_NAMES else token
    if name in BOILER or name == "header" and not inside_main:
        return "boiler", ""
    return ("named", token) if token else ("main", "") if name in MAIN else ("", "")


class Open:
    """The open elements of a page. Every question about them takes constant time, and what is
    closed is closed once, so a page costs its length however deep it is."""

    def __init__(self):
        self.names: list[str] = []
        self.zones: list[str] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.scopes = [0]                 # per open block element (and the page): its place, plus one
        self.count = Counter()            # zones of links and blocks; ``inline`` for those of other elements
        self.named: list[tuple[int, Named]] = []
        self.zoned: list[int] = []        # places of links and blocks with a zone

    def push(self, name: str, zone: str, token: str) -> None:
        place = len(self.names)
        self.names.append(name)
        self.zones.append(zone)
        self.places[name].append(place)
        if name in BLOCK:
            self.scopes.append(place + 1)
        if zone and (name == "a" or name in BLOCK):
            self.count[zone] += 1
            self.zoned.append(place)
            if zone == "named":
                self.named.append((place, Named(token, self.named[-1][1] if self.named else None)))
        elif zone in ("boiler", "named"):
            self.count["inline"] += 1

    def cut(self, place: int) -> None:
        """Close all elements from ``place`` on."""
        while len(self.names) > place:
            at, name, zone = len(self.names) - 1, self.names.pop(), self.zones.pop()
            if name:                      # a link that a later one ended has none
                self.places[name].pop()
            if name in BLOCK:
                self.scopes.pop()
            if self.zoned and self.zoned[-1] == at:
                self.zoned.pop()
                self.count[zone] -= 1
                if zone == "named":
                    self.named.pop()
            elif zone in ("boiler", "named"):
                self.count["inline"] -= 1

    def end_link(self) -> None:
        """Links don't nest: a new one ends the one before, and nothing else."""
        if self.places["a"]:
            place = self.places["a"].pop()
            if zone := self.zones[place]:
                del self.zoned[bisect_left(self.zoned, place)]
                self.count[zone] -= 1
                if zone == "named":
                    del self.named[bisect_left(self.named, place, key=lambda n: n[0])]
            self.names[place] = self.zones[place] = ""

    def last(self, name: str) -> int:
        return self.places[name][-1] if self.places[name] else -1

    def end(self, names: set, border: set) -> None:
        """End the open elements of ``names`` inside ``border``."""
        if not any(self.places[n] for n in names):
            return
        edge = max((self.last(n) for n in border), default=-1)
        inside = [self.places[n][i] for n in names if (i := bisect_right(self.places[n], edge)) < len(self.places[n])]
        if inside:
            self.cut(min(inside))

    def end_tag(self, name: str) -> None:
        place = self.last(name)
        # an inline end tag ends nothing outside its block
        if place >= 0 and (name in BLOCK or name == "a" or place >= self.scopes[-1]):
            self.cut(place)

    def zone(self) -> str:
        """The zone of text here. ``held`` is an article inside a named element; a ``main`` is
        never boilerplate for the names around it."""
        if self.count["boiler"]:
            return "boiler"
        if not self.named:
            return "main" if self.zoned else ""
        if self.zones[self.zoned[-1]] == "named":
            return "named"
        return "main" if self.last("main") > self.named[-1][0] else "held"


def blocks_of(page: str, rules: Rules = Rules()) -> list[Block]:
    """The text blocks of a page in order, with their zone and the characters inside links."""
    out: list[Block] = []
    open_ = Open()
    parts: list[str] = []
    linked, breaks, at, heading = 0, 0, 0, False
    endless: set[str] = set()             # elements whose end tag does not come any more

    def close() -> None:
        nonlocal linked, heading
        text = " ".join("".join(parts).split())
        if text:
            zone = open_.zone()
            out.append(Block(text, linked, zone, heading, open_.named[-1][1] if zone == "named" else None))
        parts.clear()
        linked, heading = 0, False

    def add(raw: str) -> None:
        nonlocal linked, breaks
        if raw:
            text = html.unescape(raw)
            if text.strip() and open_.names and open_.names[-1] == "head":
                open_.cut(len(open_.names) - 1)
            if open_.count["inline"]:
                return  # an inline element of that kind: its words alone go
            parts.append(text)
            if text.strip():
                breaks = 0
                if open_.places["a"]:
                    linked += len(" ".join(text.split()))

    while True:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if m.group(1):
            if name in BLOCK:
                close()
            open_.end_tag(name)
            continue
        if open_.names and open_.names[-1] == "head" and name not in HEAD:
            open_.cut(len(open_.names) - 1)
        if name in RAW:
            if not m.group(3).rstrip().endswith("/"):
                stop = None if name in endless else RAW_END[name].search(page, at)
                if stop is None:
                    endless.add(name)
                if stop and (stop.group() or name not in ENDED_BY_NEXT):
                    at = stop.end()
                elif name in TO_THE_END:
                    at = len(page)
                elif name == "option":
                    following = page.find("<", at)
                    at = following if following >= 0 else len(page)
            parts.append(" ")
            continue
        if name == "br":
            breaks += 1
            if breaks > 1:
                close()
            parts.append(" ")
            continue
        if name in BLOCK:
            close()
            # inline elements reach to the end of their block, links beyond it
            while open_.names and open_.names[-1] not in BLOCK and open_.names[-1] != "a":
                open_.cut(len(open_.names) - 1)
            if open_.scopes[-1] and open_.names[open_.scopes[-1] - 1] == "p":
                open_.cut(open_.scopes[-1] - 1)     # a paragraph holds no block
            if name in ENDS:
                open_.end(*ENDS[name])
            heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
        if name in VOID:
            parts.append(" " if name != "wbr" else "")
        else:
            if name == "a":
                open_.end_link()
            if name in BLOCK or not m.group(3).rstrip().endswith("/"):
                open_.push(name, *_zone(name, m.group(3), open_.count["main"] > 0))
    close()
    _settle(out, rules)
    return out


def _settle(blocks: list[Block], rules: Rules) -> None:
    """Give every block of a named element, and every held one, its zone.

    A name condemns an element only if running text is left outside it: all text in an element
    with a name of content goes, that of one with a name of layout goes if enough is left.
    Where too little is left, the names are taken for those of wrappers: of the outermost
    elements, those whose shared name holds most running text are opened, and what they hold
    counts as outside the rest. (A name of content opens last, and for the length of an
    article only.)
    """
    named: dict[Named, None] = {}
    free = 0
    for b in blocks:
        n, own = b.named, b.running(rules)
        if n is not None:
            n.own += own
        elif b.zone in ("", "main", "held"):
            free += own
        while n is not None and n not in named:
            named[n] = None
            n = n.outer
    within: dict[Named | None, list[Named]] = defaultdict(list)
    for n in named:
        within[n.outer].append(n)
    order, todo = [], list(within[None])
    while todo:                           # outer ones first
        order.append(n := todo.pop())
        todo += within[n]
    for n in reversed(order):
        n.inside += n.own
        if n.outer is not None:
            n.outer.inside += n.inside
    outer: dict[str, list[Named]] = defaultdict(list)
    by_name = Counter()
    found = within[None]
    while True:
        for n in found:
            outer[n.token].append(n)
            by_name[n.token] += n.inside
        stays = {t for t, inside in by_name.items() if inside and (
            free < rules.layout_share * inside if t in LAYOUT_NAMES else not free and inside >= rules.long)}
        if not stays:
            break
        token = max(stays & LAYOUT_NAMES or stays, key=lambda t: (by_name[t], t))
        opened, found = outer.pop(token), []
        del by_name[token]
        for n in opened:
            n.gone = False
            free += n.own
            found += within[n]
    for n in order:
        n.gone = n.gone is None or n.outer is not None and n.outer.gone
    real = any(b.zone == "main" for b in blocks)
    for b in blocks:
        if b.zone == "named":
            b.zone = "boiler" if b.named.gone else ""
        elif b.zone == "held":            # teasers beside an article, or the article itself
            b.zone = "boiler" if real else "main"
    # an article with little of the running text is a teaser: the marking says nothing
    marked, rest = (sum(b.running(rules) for b in blocks if b.zone == z) for z in ("main", ""))
    if marked < rules.article_share * rest:
        for b in blocks:
            b.zone = "" if b.zone == "main" else b.zone


def _stop_share(text: str, lists: list[frozenset]) -> float:
    return max(_stop_shares(text, lists))


def _stop_shares(text: str, lists: list[frozenset]) -> list[float]:
    """The share of the text's words that each list holds."""
    words = Counter(text.lower().split())
    bare = Counter()
    for w, n in words.items():
        bare[w.strip(".,;:!?\"'()«»“”„’…")] += n
    total = max(words.total(), 1)
    return [sum(bare[w] for w in s.intersection(bare)) / total for s in lists]


def main_text(page: str | None, rules: Rules = Rules(), stop_words: dict[str, str] | None = None) -> str:
    """The article text of a page: its kept blocks, one line each.

    First pass: a block in a menu, footer, form, advert or the like is bad for good, and
    where the page marks its article, so are other blocks outside it (unless the marked part
    is a small one: a teaser). An element that goes by its name only, or a form, is one of
    those if the running text is outside it (:func:`_settle`). For the rest link
    share, length and the share of function words decide: bad, good, or open when short or
    in between. A marked article is a prior: more link text is allowed there, and a linked
    heading is no link list. Function words count only if one of the lists fits the page's
    running text; else length and link share decide alone. Few function words make a block
    bad only together with links. Second pass: an open block takes the label of its nearest
    decided neighbours; between a good and a bad one a near-good block and a heading shortly
    before good text stay, and a short one goes; near-good ones stay where the page has no good block. Inside a
    marked article an open block goes only between two bad ones.
    """
    blocks = blocks_of(page or "", rules)
    lists = [frozenset(v.split()) for v in (stop_words or STOP_WORDS).values()]
    marked = any(b.zone == "main" for b in blocks)
    body = [b for b in blocks if b.zone != "boiler" and (b.zone == "main" or not marked)]
    running = " ".join(b.text for b in body if len(b.text) >= rules.short
                       and b.linked <= rules.link_share * len(b.text))
    fitting = [s for s, share in zip(lists, _stop_shares(running, lists)) if share >= rules.stop_fit]
    fits = bool(fitting)
    for b in body:
        share, stops = b.linked / len(b.text), _stop_share(b.text, fitting or lists)
        sparse = fits and stops < rules.stop_low
        if "\xa9" in b.text and len(b.text) < rules.long:
            b.label = "bad"
        elif marked and b.heading:
            b.label = "near"
        elif share >= rules.main_link_share or share > rules.link_share and (sparse or not marked):
            b.label = "bad"
        elif share > rules.link_share:
            b.label = "near"
        elif len(b.text) < rules.short:
            if marked:
                b.label = "good" if stops >= rules.stop_high else "near"
            else:
                b.label = "bad" if b.linked else "short"
        elif not fits or stops >= rules.stop_high and (marked or len(b.text) > rules.long):
            b.label = "good"
        else:
            b.label = "bad" if sparse and b.linked else "near"
    decided = [b.label if b.label in ("good", "bad") else "" for b in body]
    before, last = [], ""
    for d in decided:
        before.append(last)
        last = d or last
    after, last = [""] * len(body), ""
    for i in range(len(body) - 1, -1, -1):
        after[i] = last
        last = decided[i] or last
    any_good, any_decided = "good" in decided, any(decided)
    kept = []
    for i, b in enumerate(body):
        near = {before[i], after[i]} - {""}
        if decided[i]:
            stays = b.label == "good"
        elif marked:
            stays = not before[i] == after[i] == "bad"
        elif not any_good and b.label == "near":
            stays = True
        elif not near:
            stays = b.label == "near" or not any_decided
        elif len(near) == 1:
            stays = "good" in near
        else:
            reach = sum(len(x.text) for x in body[i + 1:i + 4])
            stays = b.label == "near" or b.heading and after[i] == "good" and reach > rules.heading_reach
        if stays:
            kept.append(b.text)
    return "\n".join(kept)


def extract_main_text(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (``page_id, url, html``).

    Null or empty pages, and pages without article text, give an empty text. Each page is
    read whole; pages do not depend on each other. Other columns are ignored.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_steps(batches, "html"):
            texts = [main_text(h, rules) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(
        work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
