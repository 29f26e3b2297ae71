"""HTML extraction by deducing a template per host from equivalence classes.

Tokens are tags (with the path of open elements) and runs of text. Tokens of one
host that occur equally often on each page share an occurrence vector and form an
equivalence class; classes that are frequent and large enough are candidates. A
class is valid if its tokens come in one order on every page that holds it, and if
it lies in one slot of another class (or in none) there: so valid classes nest into
the host's template, and what lies between neighbouring tokens of a class is a slot.

The slots decide what is extracted. From the whole page down, the element whose slots
hold most of the running text (text that is no token of the template and no link) is
entered as long as there is one; it is the article. A block of text that is part of the
template is no content, wherever it stands, and elements that are mostly links go. Names of
elements and words of class attributes are a second signal: they lower an element's
weight, and drop parts within the article. A host with too few pages, and a page
without its host's article, use the template of all pages together; a page that this
does not fit either goes by the names alone.

Occurrence vectors never meet in one place: the exclusive or over pages of a hash of
page and count stands for the vector, so counting is one partial aggregation. So are
the counts of orders, nestings and words in slots."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter, defaultdict

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfuse.llm.common import materialize, ship, table, text_slices

LEAST_PAGES = 4  # a host with fewer has no template of its own
SHARE = 0.6  # of a host's pages that hold a class
CLASS_SIZE = 2
VALID = 0.9  # of the pages that hold a class: in one order, in one slot
MOST = 0.6  # of an element's running text: a part with as much is entered
LINKS = 0.5  # of an element's words: with more in links it is a menu
COPY = 50  # words of template text in an article that has little else: the page is a copy of a frequent one
HOSTS, TOKENS = 8192, 1 << 20  # templates broadcast: of so many hosts, of so many tokens in all; other hosts' are joined
EVERY = "*"

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?<=\s)(hidden)(?=[\s/>]|$)")
RAW = frozenset("script style textarea title noscript iframe template svg math select button canvas object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: A start tag on the left ends an open element on the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("article main section div body html table td th li nav header footer aside form blockquote".split())
BOILERPLATE = frozenset("head nav header footer aside form dialog menu".split()) | RAW
BOILERPLATE_WORDS = frozenset(
    "nav navbar navigation menu submenu header masthead topbar footer sidebar side aside ad ads adv advert advertisement adsense banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay subscribe subscription newsletter signup login search share sharing social related recommended recommendations "
    "comment comments reply replies discussion disqus respond breadcrumb breadcrumbs pagination pager toolbar widget widgets skip copyright legal form".split()
)
ENTERED = frozenset("html body main article section div center table tbody tr td".split())
UNTOLD = frozenset("div section".split())  # without marks, told apart by their place among their like
HEADINGS = frozenset("h1 h2".split())
START, END, TEXT = range(3)
TAGS = 200_000
CONTENT_WORDS = frozenset("article content main post entry story body text maintext".split())


def host_of(url: str | None) -> str:
    found = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


class Element:
    """An open element. role: hash of its path; dropped, content: what names say of it,
    dropped_in and content_in: or of one it is in."""

    __slots__ = ("parent", "name", "role", "dropped", "content", "dropped_in", "content_in", "link", "like")

    def __init__(self, parent, name, role, dropped, content):
        self.parent, self.name, self.role, self.dropped, self.content = parent, name, role, dropped, content
        self.dropped_in = dropped or parent is not None and parent.dropped_in
        self.content_in = content or parent is not None and parent.content_in
        self.link = name == "a" or parent is not None and parent.link
        self.like = None


_tags: dict[tuple[int, str], tuple] = {}


def _tag(outer: int, name: str, rest: str) -> tuple:
    """Of a start tag in an element of role `outer`: role, dropped, content, and whether it has marks."""
    found = _tags.get((outer, name, rest))
    if found:
        return found
    marks, hidden = set(), False
    for a in ATTRIBUTE.finditer(rest) if rest.strip(" /") else ():
        key, value = (a[1] or a[5]).lower(), a[2] or a[3] or a[4] or ""
        if key in ("class", "id", "role"):
            marks.update(w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()) if w)
        hidden |= key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value) is not None
    role = xxhash.xxh64_intdigest(f"{outer}<{name} {' '.join(sorted(marks))}", 1) >> 1
    content = name in ("article", "main") or bool(marks & CONTENT_WORDS)
    dropped = name in BOILERPLATE or hidden or (bool(marks & BOILERPLATE_WORDS) and name not in ("html", "body", "article", "main"))
    found = role, dropped, content, bool(marks)
    if len(rest) < 200:
        if len(_tags) >= TAGS:
            _tags.clear()
        _tags[outer, name, rest] = found
    return found


def end_of(role: int) -> int:
    """The role of the end tag of an element."""
    return role ^ 0x2545F4914F6CDD1D


class Page:
    """A page's tokens, (kind, role, element, text): a start tag comes with its own
    element, an end tag and a run of text with the innermost one open. Open elements
    are looked up by name, so nesting costs no more than its number of tags."""

    def __init__(self, source: str):
        self.items: list[tuple] = []
        self.stack: list[Element] = []
        self.open: dict[str, list[int]] = defaultdict(list)  # places in the stack, by name
        self.scopes: list[int] = []
        top: dict[int, int] = {}  # unmarked elements outside of any, by role
        at, n = 0, len(source)
        while at < n:
            m = TOKEN.match(source, at)
            at = m.end()
            if m[7] is not None:
                self._text(m[7])
                continue
            name = m[2] or m[5]
            if name is None:
                continue
            name, closing, rest = name.lower(), m[1] or m[4], m[3] or m[6] or ""
            if closing:
                self._close(name)
                continue
            if name in ENDS_P:
                self._implied({"p"})
            if name in CLOSES:
                self._implied(CLOSES[name])
            if name in ("article", "main"):
                while self.stack and self.stack[-1].name not in ("html", "body", "main", "article", "div", "section"):
                    self._pop()
            outer = self.stack[-1] if self.stack else None
            role, dropped, content, marked = _tag(outer.role if outer else 0, name, rest)
            if not marked and name in UNTOLD:
                if outer and outer.like is None:
                    outer.like = {}
                like = outer.like if outer else top
                k = like[role] = like.get(role, -1) + 1
                role = role + k * 0x9E3779B97F4A7C1 & (1 << 63) - 1
            element = Element(outer, name, role, dropped, content)
            self.items.append((START, role, element, ""))
            if name in VOID or rest.rstrip().endswith("/") and name not in SCOPE:
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                at = end.end() if end else n
                self.items.append((END, end_of(role), element, ""))
                continue
            self.open[name].append(len(self.stack))
            if name in SCOPE:
                self.scopes.append(len(self.stack))
            self.stack.append(element)

    def _pop(self) -> None:
        name = self.stack.pop().name
        self.open[name].pop()
        if name in SCOPE:
            self.scopes.pop()

    def _text(self, text: str) -> None:
        element = self.stack[-1] if self.stack else None
        words = text.split()
        role = xxhash.xxh64_intdigest(f"{element.role if element else 0}\"{' '.join(words)}", 2) >> 1 if words else 0
        self.items.append((TEXT, role, element, text if words else " "))

    def _last(self, name: str) -> int:
        places = self.open.get(name)
        return places[-1] if places else -1

    def _close(self, name: str) -> None:
        at = self._last(name)
        if at < 0 or name not in SCOPE and self.scopes and self.scopes[-1] > at:
            return
        while len(self.stack) > at + 1:
            self._pop()
        element = self.stack[-1]
        self._pop()
        self.items.append((END, end_of(element.role), element, ""))

    def _implied(self, names: set) -> None:
        at = max(map(self._last, names))
        if at >= 0:
            barrier = max(map(self._last, SCOPE - names)) if names & SCOPE else self.scopes[-1] if self.scopes else -1
            if barrier < at:
                while len(self.stack) > at:
                    self._pop()

    def roles(self) -> Counter:
        return Counter(x[1] for x in self.items if x[1])


class Arrangement:
    """How the classes of a template lie on one page. class_of: role -> class.

    order: for each class its tokens' roles as they come, or None if they come in no
    one order; times: how often the class comes; inside: the class and slot that it lies
    in, (0, 0) for none, None if that differs or it crosses another class; words: for each slot,
    text that is no token: all words, those in links, those in elements that names drop."""

    def __init__(self, page: Page, class_of: dict[int, int]):
        places: dict[int, list[int]] = defaultdict(list)
        for i, x in enumerate(page.items):
            c = class_of.get(x[1])
            if c is not None:
                places[c].append(i)
        size = Counter(class_of.values())
        self.order: dict[int, tuple | None] = {}
        self.times: dict[int, int] = {}
        self.inside: dict[int, tuple[int, int] | None] = {}
        self.words: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0, 0])
        spans = []
        for c, at in places.items():
            roles, n = [page.items[i][1] for i in at], size[c]
            first = roles[:n]
            if len(roles) % n or len(set(first)) < n or first * (len(roles) // n) != roles:
                self.order[c] = None
                continue
            self.order[c], self.times[c] = tuple(first), len(roles) // n
            spans += [(at[k], at[k + n - 1], c, at[k : k + n]) for k in range(0, len(at), n)]
        spans.sort(key=lambda x: (x[0], -x[1]))
        open_: list[tuple] = []
        k = 0
        for i, (kind, role, element, text) in enumerate(page.items):
            while open_ and open_[-1][1] < i:
                open_.pop()
            while k < len(spans) and spans[k][0] == i:
                _, end, c, _ = span = spans[k]
                k += 1
                where = (0, 0)
                if open_:
                    outer = open_[-1]
                    slot = bisect_right(outer[3], i) - 1
                    where = (outer[2], slot) if slot + 1 < len(outer[3]) and end < outer[3][slot + 1] else None
                if where is None or self.inside.setdefault(c, where) != where:
                    self.inside[c] = None
                if where is not None:
                    open_.append(span)
            if kind == TEXT and role and role not in class_of:
                n = len(text.split())
                for where in [(0, 0), *((x[2], bisect_right(x[3], i) - 1) for x in open_)]:
                    said = self.words[where]
                    said[0] += n
                    if element is not None:
                        said[1] += n if element.link else 0
                        said[2] += n if element.dropped_in else 0


class Template:
    """What the valid classes say of a host's pages: the article's element (or, where it
    has none of its own, the tokens before and after it), headings before it, elements
    in it that are no content, and template text."""

    __slots__ = ("inside", "left", "right", "heading", "dropped", "texts")

    def __init__(self, inside=0, left=0, right=0, heading=0, dropped=(), texts=()):
        self.inside, self.left, self.right, self.heading, self.dropped, self.texts = inside, left, right, heading, frozenset(dropped), frozenset(texts)

    def __bool__(self) -> bool:
        return bool(self.inside or self.left)


class Deduced:
    """The template of one host, from counts over its pages.

    orders: (class, tokens in order, pages, times) with tokens (kind, role, name, content,
    dropped); places: (class, (outer, slot) or None, pages); words: {(class, slot): [all, links, dropped]}."""

    def __init__(self, orders: list, places: list, words: dict):
        held = Counter()
        for c, _, pages, _ in orders:
            held[c] += pages
        self.order = {c: tokens for c, tokens, pages, _ in orders if tokens is not None and pages >= VALID * held[c]}
        often = {c: times / max(pages, 1) for c, tokens, pages, times in orders if tokens is not None}
        where = {c: at for c, at, pages in places if at is not None and pages >= VALID * held[c]}
        self.order = {c: t for c, t in self.order.items() if c in where}
        self.once = {c for c in self.order if often[c] < 1.5}
        self.within: dict[tuple[int, int], list[int]] = defaultdict(list)
        for c in sorted(self.order):
            outer, slot = where[c]
            self.within[(outer, slot) if outer in self.order else (0, 0)].append(c)
        self.words = words

    def slot(self, c: int, j: int) -> list[int]:
        """Words, words in links and words in dropped elements of a slot, with what is nested in it."""
        return self.words.get((c, j), [0, 0, 0])

    def span(self, c: int, a: int, b: int) -> list[int]:
        return [sum(x) for x in zip([0, 0, 0], *(self.slot(c, j) for j in range(a, b)), strict=True)]

    @staticmethod
    def running(words: list[int]) -> float:
        return max(0.0, words[0] - words[1] - 0.95 * words[2])

    def elements(self, c: int, a: int, b: int) -> list[tuple[int, int, int]]:
        """The outermost elements with both tags among tokens a to b of a class: (class, start, end)."""
        tokens, out, i = self.order[c], [], a
        place = {t[1]: k for k, t in enumerate(tokens)}
        while i < b:
            end = place.get(end_of(tokens[i][1]), -1) if tokens[i][0] == START else -1
            if i < end < b:
                out.append((c, i, end))
                i = end
            i += 1
        return out

    def parts(self, at: tuple[int, int, int] | None) -> list[tuple[int, int, int]]:
        """The elements directly in an element, or on the page."""
        if at is None:
            return [e for c in self.within.get((0, 0), ()) if c in self.once for e in self.elements(c, 0, len(self.order[c]))]
        c, a, b = at
        out = self.elements(c, a + 1, b)
        covered = {j for _, s, e in out for j in range(s, e)}
        return out + [e for j in range(a, b) if j not in covered for k in self.within.get((c, j), ()) if k in self.once for e in self.elements(k, 0, len(self.order[k]))]

    def template(self) -> Template:
        texts = [t[1] for tokens in self.order.values() for t in tokens if t[0] == TEXT]
        way: list[tuple[int, int, int] | None] = [None]
        total = self.slot(0, 0)
        amount = self.running(total)
        while amount > 0:
            inner = [(self.running(self.span(*e)), e) for e in self.parts(way[-1]) if self.order[e[0]][e[1]][2] in ENTERED]
            best = max(inner, default=(0.0, None), key=lambda x: (x[0], x[1][1]))
            if best[0] < MOST * amount or best[1] is None:
                break
            amount = best[0]
            way.append(best[1])
        name = lambda e: self.order[e[0]][e[1]][2]
        # an element around it that is named so is the article, if it adds little
        for e in way[1:-1]:
            if self.order[e[0]][e[1]][3] and self.running(self.span(*e)) <= 1.25 * amount:
                del way[way.index(e) + 1 :]
                break
        at = way[-1]
        if at is None or name(at) in ("html", "body"):
            return self._between(at, texts)
        c, a, b = at
        heading = 0
        if not self._headings(at):
            outer = way[-2] if len(way) > 1 else None
            before = [self.order[k][s][1] for e in ([outer] if outer else self.parts(None)) for k, s in self._headings(e) if k != c or s < a]
            heading = before[-1] if before else 0
        return Template(self.order[c][a][1], heading=heading, dropped=self._menus(at), texts=texts)

    def _headings(self, at) -> list[tuple[int, int]]:
        out = []
        for c, a, b in [at, *self.parts(at)] if at else []:
            out += [(c, i) for i in range(a, b) if self.order[c][i][0] == START and self.order[c][i][2] in HEADINGS and not self.order[c][i][4]]
        return sorted(set(out))

    def _menus(self, at) -> list[int]:
        """Roles of the elements in one that are mostly links."""
        out, todo, seen = [], [at], set()
        while todo:
            c, a, b = e = todo.pop()
            if e in seen:
                continue
            seen.add(e)
            words, links, _ = self.span(c, a, b)
            if e != at and words and links > LINKS * words:
                out.append(self.order[c][a][1])
                continue
            todo += self.elements(c, a + 1, b)
            todo += [x for j in range(a, b) for k in self.within.get((c, j), ()) for x in self.elements(k, 0, len(self.order[k]))]
        return out

    def _between(self, at, texts) -> Template:
        """An article that has no element of its own: the slot with most running text directly in `at`."""
        own = [(c, j) for c in self.within.get((0, 0), ()) if c in self.once for j in range(len(self.order[c]) - 1)] if at is None else [(at[0], j) for j in range(at[1], at[2])]
        inner = {(c, j) for c, a, b in self.parts(at) for j in range(a, b)}
        best = max(((self.running(self.slot(*x)), x) for x in own if x not in inner), default=(0.0, None), key=lambda x: x[0])
        if not best[0]:
            return Template(texts=texts)
        c, j = best[1]
        tokens = self.order[c]
        before = [i for i in range(j + 1) if tokens[i][0] == START and tokens[i][2] in HEADINGS and not tokens[i][4]]
        return Template(left=tokens[j][1], right=tokens[j + 1][1], heading=tokens[before[-1]][1] if before else 0, texts=texts)


def _kept(page: Page, template: Template):
    """For each item whether it is text of the article; None if the page has no article by this template."""
    inside = {None: False}
    out = {None: False}  # elements in the article that are no content
    found, between, marks = False, False, []
    for kind, role, element, _ in page.items:
        if kind == START:
            outer = element.parent
            own = role == template.inside or role == template.heading
            inside[element] = inside.get(outer, False) or own
            out[element] = False if own and not inside.get(outer, False) else out.get(outer, False) or element.dropped or role in template.dropped
            found |= role == template.inside
        if template.left and role in (template.left, template.right):
            between = role == template.left
            found |= between
        marks.append(kind == TEXT and role != 0 and (inside.get(element, False) or between) and not out.get(element, False))
    return marks if found else None


def by_names(page: Page) -> list[bool]:
    """For each item whether it is text that names call content."""
    anywhere = any(e is not None and e.content and not (e.parent is not None and e.parent.dropped_in) for _, _, e, _ in page.items)
    return [k == TEXT and r != 0 and not (e is not None and e.dropped_in) and (not anywhere or e is not None and e.content_in) for k, r, e, _ in page.items]


def main_text(source: str, *templates: Template) -> str:
    """The article's text: by the first of the templates that fits the page, else by names."""
    page = Page(source)
    marks, texts = None, frozenset()
    for t in templates:
        if t and (marks := _kept(page, t)) is not None:
            texts = t.texts
            break
    if marks is None:
        marks = by_names(page)
        texts = next((t.texts for t in templates if t.texts), texts) if not any(e is not None and e.content_in for _, _, e, _ in page.items) else texts
    blocks: list[list[tuple[str, bool]]] = [[]]  # each of runs of text, with whether the template has them
    for mark, (kind, role, element, text) in zip(marks, page.items, strict=True):
        if kind != TEXT:
            if element.name not in INLINE or element.name == "br":
                blocks.append([])
        elif mark:
            blocks[-1].append((text, role in texts))
        elif text == " ":
            blocks[-1].append((text, True))
    # a block goes if the template has all of it
    fixed = [all(f for _, f in x) for x in blocks]
    if any(fixed):
        n = [sum(len(t.split()) for x, f in zip(blocks, fixed, strict=True) if f == k for t, _ in x) for k in (False, True)]
        if n[1] >= COPY and 5 * n[0] < n[1]:
            fixed = [False] * len(blocks)
    found = (" ".join(html.unescape("".join(t for t, _ in x)).split()) for x, f in zip(blocks, fixed, strict=True) if x and not f)
    return " ".join(x for x in found if x)


def _tokens(batches):
    """Per slice and host: each token's pages, and the number that stands for its vector.
    A page is known by its place, so repeated rows and missing ids don't cancel out."""
    context = TaskContext.get()
    partition, row = context.partitionId() if context else 0, 0
    for part, raw in text_slices(batches, "html", most=8 << 20):
        hosts = part.column(part.schema.get_field_index("host")).to_pylist()
        seen: dict[tuple[str, int], list[int]] = {}
        for host, x in zip(hosts, raw, strict=True):
            row += 1
            got = seen.setdefault((host, 0), [0, 0])
            got[0] += 1
            stamps: dict[int, int] = {}
            for role, n in Page(x.decode()).roles().items():
                h = stamps.get(n)
                if h is None:
                    h = stamps[n] = xxhash.xxh64_intdigest(f"{partition} {row} {n}", 3) >> 1
                got = seen.get((host, role))
                if got is None:
                    seen[host, role] = [1, h]
                else:
                    got[0] += 1
                    got[1] ^= h
        yield pa.record_batch(
            [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())],
            ["host", "role", "pages", "vector"],
        )


def classes(pages: DataFrame) -> DataFrame:
    """(host, n_pages, roles, of): the tokens of each host's frequent, large classes and
    the class of each; host '*' has those of all pages. pages: page_id, host, html."""
    counts = pages.mapInArrow(_tokens, "host string, role long, pages long, vector long")
    total = materialize(counts.groupBy("host", "role").agg(F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector")))
    every = total.groupBy("role").agg(F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"))
    total = total.where(F.col("pages") > 1).union(every.where(F.col("pages") > 1).select(F.lit(EVERY).alias("host"), "role", "pages", "vector"))
    n = total.where("role = 0").select("host", F.col("pages").alias("n_pages")).where(F.col("n_pages") >= LEAST_PAGES)
    often = total.where("role <> 0").join(n, "host").where(F.col("pages") >= SHARE * F.col("n_pages"))
    found = often.groupBy("host", "n_pages", "pages", "vector").agg(F.collect_list("role").alias("roles")).where(F.size("roles") >= CLASS_SIZE)
    one = F.transform("roles", lambda r: F.struct(r.alias("role"), F.col("vector").alias("of")))
    both = found.groupBy("host", "n_pages").agg(F.array_sort(F.flatten(F.collect_list(one))).alias("both"))
    return both.select("host", "n_pages", F.col("both.role").alias("roles"), F.col("both.of").alias("of"))


ARRANGED = "host string, kind int, class long, outer long, slot int, tokens array<string>, pages long, times long, words long, links long, dropped long"


def _told(token: tuple, names: dict) -> str:
    element = names.get(token)
    return f"{TEXT} {token} - 0 0" if element is None else f"{element[0]} {token} {element[1].name} {int(element[1].content)} {int(element[1].dropped_in)}"


def _arranged(held):
    """Counts of orders (kind 0), places (1) and words (2) of the classes, by host and for all pages."""

    def run(batches):
        own = held and held.value
        every = held.value.get(EVERY) if held else None
        every = dict(zip(*every, strict=True)) if every else {}
        cached: dict[str, dict] = {}
        for part, raw in text_slices(batches, "html", most=8 << 20):
            hosts = part.column(part.schema.get_field_index("host")).to_pylist()
            if own is None:
                lists = zip(part.column(part.schema.get_field_index("roles")).to_pylist(), part.column(part.schema.get_field_index("of")).to_pylist(), strict=True)
                found = [dict(zip(r, c, strict=True)) for r, c in lists]
            else:
                if len(cached) > 256:
                    cached.clear()
                for h in set(hosts):
                    if h not in cached:
                        cached[h] = dict(zip(*own[h], strict=True)) if h in own else {}
                found = [cached[h] for h in hosts]
            counts: dict[tuple, list[int]] = defaultdict(lambda: [0, 0, 0, 0, 0])
            tokens: dict[tuple, list[str]] = {}
            for host, class_of, x in zip(hosts, found, raw, strict=True):
                page = Page(x.decode())
                names = None
                for h, of in ((host, class_of), (EVERY, every)):
                    if not of:
                        continue
                    a = Arrangement(page, of)
                    for c, order in a.order.items():
                        number = xxhash.xxh64_intdigest(str(order), 4) >> 1 if order else 0
                        said = counts[h, 0, c, number, 0]
                        said[0] += 1
                        said[1] += a.times.get(c, 0)
                        if order and (h, c, number) not in tokens:
                            names = names or {r: (k, e) for k, r, e, _ in page.items if k != TEXT}
                            tokens[h, c, number] = [_told(r, names) for r in order]
                    for c, where in a.inside.items():
                        counts[(h, 1, c, *(where or (0, -1)))][0] += 1
                    for (c, j), words in a.words.items():
                        said = counts[h, 2, c, 0, j]
                        said[0] += 1
                        for i in range(3):
                            said[2 + i] += words[i]
            if counts:
                keys, values = list(zip(*counts, strict=True)), list(zip(*counts.values(), strict=True))
                lists = [tokens.get((k[0], k[2], k[3])) if k[1] == 0 else None for k in counts]
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
                yield pa.record_batch([*[pa.array(x, t) for x, t in zip(keys, kinds, strict=True)], pa.array(lists, pa.list_(pa.string())), *[pa.array(x, pa.int64()) for x in values]], [c.split()[0] for c in ARRANGED.split(", ")])

    return run


def _deduce(batches):
    """(host, template) from a host's counts."""
    for batch in batches:
        out = []
        for host, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows.sort(key=lambda r: (r["kind"], r["class"], -r["pages"], r["outer"], r["slot"]))
            split = lambda t: (int(t[0]), int(t[1]), t[2], t[3] == "1", t[4] == "1")
            orders = [(r["class"], [split(t.split(" ")) for t in r["tokens"]] if r["tokens"] else None, r["pages"], r["times"]) for r in rows if r["kind"] == 0]
            places = [(r["class"], None if r["slot"] < 0 else (r["outer"], r["slot"]), r["pages"]) for r in rows if r["kind"] == 1]
            words = {(r["class"], r["slot"]): [r["words"], r["links"], r["dropped"]] for r in rows if r["kind"] == 2}
            t = Deduced(orders, places, words).template()
            out.append((host, t.inside, t.left, t.right, t.heading, sorted(t.dropped), sorted(t.texts)))
        columns = list(zip(*out, strict=True)) if out else [[]] * 7
        kinds = (pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["host", "inside", "left", "right", "heading", "dropped", "texts"])


TEMPLATE = ("inside", "left", "right", "heading", "dropped", "texts")


def _extract(held):
    """held: templates by host. Without one of its own, a row may bring its template along."""

    def run(batches):
        known = {h: Template(*x) for h, x in held.value.items()}
        every = known.get(EVERY, Template())
        for part, raw in text_slices(batches, "html", most=8 << 20):
            at = part.schema.get_field_index
            if at("inside") >= 0:
                found = [Template(*[x or () if isinstance(x, list) else x or 0 for x in r]) for r in zip(*(part.column(at(c)).to_pylist() for c in TEMPLATE), strict=True)]
            else:
                found = [known.get(h, every) for h in part.column(at("host")).to_pylist()]
            texts = [main_text(x.decode(), t, every) for x, t in zip(raw, found, strict=True)]
            yield pa.record_batch([part.column(at(c)) for c in ("page_id", "url")] + [pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def _largest(known: DataFrame, size) -> list[str]:
    """The hosts with most pages whose templates, together, are small enough to broadcast; '*' is one."""
    room, out = TOKENS, []
    for r in known.select("host", (size + 8).alias("size")).orderBy((F.col("host") == EVERY).desc(), F.desc("n_pages"), "host").limit(HOSTS + 1).collect():
        if r["size"] <= room:
            room -= r["size"]
            out.append(r["host"])
    return out


def templates(pages: DataFrame) -> DataFrame:
    """(host, n_pages, inside, left, right, heading, dropped, texts): each host's template; '*' has that of
    all pages. pages: page_id, host, html."""
    known = materialize(classes(pages))
    sent = known.where(F.col("host").isin(_largest(known, F.size("roles"))))
    held = pages.sparkSession.sparkContext.broadcast({r["host"]: (r["roles"], r["of"]) for r in sent.collect()})
    arranged = pages.mapInArrow(_arranged(held), ARRANGED)
    rest = known.join(sent.select("host"), "host", "left_anti")
    if rest.head(1):
        theirs = pages.join(rest.select("host", "roles", "of"), "host").select("page_id", "host", "html", "roles", "of")
        arranged = arranged.union(theirs.mapInArrow(_arranged(None), ARRANGED))
    sums = arranged.groupBy("host", "kind", "class", "outer", "slot").agg(F.max("tokens").alias("tokens"), *[F.sum(c).alias(c) for c in ("pages", "times", "words", "links", "dropped")])
    one = sums.groupBy("host").agg(F.collect_list(F.struct("kind", "class", "outer", "slot", "tokens", "pages", "times", "words", "links", "dropped")).alias("rows"))
    deduced = one.mapInArrow(_deduce, "host string, inside long, left long, right long, heading long, dropped array<long>, texts array<long>")
    return deduced.join(known.select("host", "n_pages"), "host")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every row of pages (page_id, url, html).

    Null html counts as empty and has an empty text; a null or odd url counts as a
    host without a name; repeated rows are extracted alike; further columns are left
    out; an empty table gives an empty one. A page is held whole by one task; its
    tokens take some ten times its size, however they nest."""
    spark = pages.sparkSession
    ship(spark)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host.alias("host"))
    known = materialize(templates(rows))
    sent = known.where(F.col("host").isin(_largest(known, F.size("dropped") + F.size("texts"))))
    held = spark.sparkContext.broadcast({r["host"]: tuple(r[c] for c in TEMPLATE) for r in sent.collect()})
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string"
    rest = known.join(sent.select("host"), "host", "left_anti")
    if not rest.head(1):
        return rows.mapInArrow(_extract(held), schema)
    rest = materialize(rest.select("host", *TEMPLATE))
    theirs, others = rows.join(rest, "host"), rows.join(rest.select("host"), "host", "left_anti")
    return others.mapInArrow(_extract(held), schema).union(theirs.mapInArrow(_extract(held), schema))


def op2_html(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
