"""HTML extraction by tag-path ratios.

A page's text falls into blocks, each with the path of block elements from the root to it. Text length, link text and
punctuation are summed by path; a path's two ratios (text by block, punctuation by block) are smoothed with those of the
paths beside it, fused, and held against the page's best path. What stands in the same container as the best paths is
content too, so short paragraphs and headings of an article stay, as do headings and leads in the parents of that container.
Elements that say what they are (menus, footers, sidebars, scripts, styles, markup comments, hidden ones) are never candidates,
nor are forms, unless they hold what the page is about (pages of some servers are one form). What names in class, id and role mark is no candidate beside other text, but a page (nearly) all of whose text
stands in such elements keeps it."""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Elements that start a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that head a section.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements without content of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; all but the last two are never text of a page.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea title xmp".split())
#: Elements that are never content.
NEVER = frozenset("head nav footer aside button select option menu dialog search datalist".split())
#: Elements that are forms, or layout where they hold the page's text (see forms).
FORMS = frozenset({"form", "fieldset"})
#: Words of class, id and role that mark what is not content.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial alert alerts banner banners breadcrumb breadcrumbs bio byline comment comments commenting complementary consent contentinfo cookie cookies copyright disqus disclaimer footer gdpr header hidden login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
#: Words that say nothing of what an element holds; a token's last other word is what it names.
AROUND = frozenset(
    "area articles author back bar block bottom box bottombar btn button buttons container count fixed for form global google group icon icons info inner item items law left link links list main message mobile outer overlay page policy post posts primary reader readers right row secondary section settings site slot sticky stories the to top unit user users visitor warning wrap wrapper zone".split()
)
#: Words that make a token one of layout or state (has-sidebar, overflow-hidden), whatever else it has.
LAYOUT = frozenset("body closed col cols column columns content disabled enabled grid has is layout no not off on open opened overflow template theme with without".split())
#: What a mark counts in a token, more where it is what the token names; what another word takes off; the least sum that counts.
MARK, NAMED, OTHER, LEAST = 1.0, 2.0, 0.75, 0.5
#: Marks that head a page only alone or with these words, and within article or main never.
HEADS, OF_SITE = frozenset({"banner", "header"}), frozenset("bar bottom container fixed global inner mobile outer primary site sticky top wrap wrapper".split())
#: Marks that count on article and main too; the rest there is layout.
OTHERS = frozenset("ad ads adv advert adverts advertisement advertising advertorial comment comments promo promoted recommended related replies reply sponsor sponsored teaser".split())
WITHIN = MARKS - HEADS
#: A start tag that closes the open ones named here, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr"}, {"table"}), "body": ({"head"}, {"html"}),
}
#: A comment, a declaration or a tag with its attributes; quotes hold a > only right behind an equals sign.
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|$)|'([^']*)(?:'|$)|([^\s>]+)))?")
SELF_CLOSED = re.compile(r"(?:^|[\s\"']|(?:^|\s)[^\s=\"']+)/$")
NUMBER = re.compile(r"\d+(?:x\d+)?")
WORD = re.compile(r"[^\W\d_]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPACES = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")
#: Share of the best fused score that a path needs, links' most share of a path's text, weight of the paths beside it, and the
#: least share of the unmarked text in all text without which what class, id or role mark is a candidate too.
KEEP, LINKS, BESIDE, MARKED = 0.25, 0.6, 0.5, 0.02
#: Characters of a block that is a passage of text.
PASSAGE = 80


def names_other(token: str, counted: frozenset[str] = MARKS) -> bool:
    """Whether a token of class, id or role names what is not content, by a score of its words: marks count, most of all the last
    word that says something; other words speak against it."""
    words = WORD.findall(CAMEL.sub(" ", NUMBER.sub(" ", token)).lower())
    parts = set(words)
    marks = parts & MARKS
    if not marks & counted or parts & LAYOUT or marks <= HEADS and not parts - marks <= OF_SITE:
        return False
    last = next((w for w in reversed(words) if w not in AROUND), words[-1])
    return MARK * len(marks) + NAMED * (last in marks) - OTHER * len(parts - MARKS - AROUND) >= LEAST


def marked(attributes: str, counted: frozenset[str] = MARKS) -> int:
    """2 if the attributes hide the element, 1 if they name something that is not content, else 0."""
    seen, named = set(), 0
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in seen:  # of repeated attributes the first counts
            continue
        seen.add(name)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.lower().replace(" ", ""):
            return 2
        if name in ("class", "id", "role") and any(names_other(t, counted) for t in value.split()):
            named = 1
    return named


class Paths:
    """The paths of block elements from the root, each once: parent, name, whether class, id or role mark it, and whether it is
    within article or main. A path's parent has a smaller number; 0 is the root."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, str, bool, int], int] = {}
        self.parent, self.name, self.marked, self.inside = [0], [""], [False], [False]
        self.form, self.forms = [0], [False]  # the outermost form around a path, 0 if none; whether a form holds article or main

    def below(self, parent: int, name: str, mark: bool) -> int:
        mark, form = mark or self.marked[parent], self.form[parent]
        if name in FORMS and not form:  # each is a path of its own
            form = len(self.forms)
            self.forms.append(False)
        if name in ("article", "main"):
            self.forms[form] = True
        key = (parent, name, mark, form)
        if key not in self.known:
            self.known[key] = len(self.name)
            for column, value in ((self.parent, parent), (self.name, name), (self.marked, mark), (self.inside, self.inside[parent] or name in ("article", "main")), (self.form, form)):
                column.append(value)
        return self.known[key]

    def above(self, path: int) -> list[int]:
        """The paths from the root's child to this one."""
        out = []
        while path:
            out.append(path)
            path = self.parent[path]
        return out[::-1]


class Open:
    """The open elements, and where those of each name stand."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.blocks: list[int] = []  # depths of block elements
        self.paths: list[int] = [0]  # the path at each depth
        self.at: dict[str, list[int]] = {}

    def push(self, name: str, path: int) -> None:
        self.at.setdefault(name, []).append(len(self.names))
        if name in BLOCKS:
            self.blocks.append(len(self.names))
        self.names.append(name)
        self.paths.append(path)

    def pop(self) -> str:
        name = self.names.pop()
        self.at[name].pop()
        self.paths.pop()
        if name in BLOCKS:
            self.blocks.pop()
        return name

    def last(self, names) -> int:
        """Depth of the innermost open element of these names, -1 if there is none."""
        return max((places[-1] for n in names if (places := self.at.get(n))), default=-1)

    def first_above(self, names, depth: int) -> int | None:
        """Depth of the outermost open element of these names that stands deeper than depth."""
        found = [places[i] for n in names if (places := self.at.get(n)) and (i := bisect_right(places, depth)) < len(places)]
        return min(found, default=None)


def blocks(page: str) -> tuple[list[tuple[str, int, int]], Paths]:
    """Text, path and characters within links of each block, in page order, and the paths; what is never content is left out.
    The time is in proportion to the page, however deep its elements are nested."""
    found: list[tuple[str, int, int]] = []
    paths, stack = Paths(), Open()
    off = 0  # depth at which what is never content began, 0 if not within any
    parts: list[str] = []
    linked = in_link = 0
    ends: dict[str, re.Pattern] = {}

    def flush() -> None:
        nonlocal linked
        text = SPACES.sub(" ", html.unescape("".join(parts))).strip() if parts else ""
        if text:
            found.append((text, stack.paths[-1], linked))
        parts.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal off, in_link
        while len(stack.names) > to:
            if not off and (stack.names[-1] in BLOCKS or stack.paths[-1] != stack.paths[-2]):
                flush()
            if stack.pop() == "a":
                in_link = 0
            if off > len(stack.names):
                off = 0

    at, n = 0, len(page)
    gone: set[str] = set()  # elements of raw text that are closed nowhere behind
    while at < n:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text and not off:
            parts.append(text)
            if in_link:
                linked += len(text)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            place = stack.last((name,))
            if place >= 0 and (name in BLOCKS or place > (stack.blocks[-1] if stack.blocks else -1)):
                pop(place)
            continue
        if name in ("svg", "math") and m[3] and SELF_CLOSED.search(m[3]):
            continue
        if name in RAW:
            end = None if name in gone else ends.setdefault(name, re.compile(rf"</{re.escape(name)}\s*>?", re.I)).search(page, at)
            if not end:
                gone.add(name)
                if name in ("svg", "math"):  # what follows is the page's again
                    continue
            at = n if not end else end.end() if page[end.end() - 1 : end.end()] == ">" or end.end() >= n else page.find(">", end.end()) + 1 or n
            continue
        if name in VOID:
            if not off and name == "hr":
                flush()
            elif not off and name == "br":
                parts.append("\n")
            continue
        if name in BLOCKS:
            if not off:
                flush()
            if stack.at.get("p") and name not in CLOSES:
                place = stack.last(("p",))
                if place == stack.blocks[-1]:
                    pop(place)
            if name in CLOSES:
                names, stop = CLOSES[name]
                first = stack.first_above(names, stack.last(stop))
                if first is not None:
                    pop(first)
        elif name == "a":
            in_link = 1
        here = stack.paths[-1]
        inside = bool(stack.at.get("article") or stack.at.get("main")) or name in ("article", "main")
        counted = OTHERS if name in ("article", "main") else WITHIN if inside else MARKS
        mark = marked(m[3], counted) if m[3] and name not in ("html", "body") else 0
        never = name in NEVER or name == "header" and not inside or mark == 2
        # a marked element within a line is a path of its own, so its text goes apart from the line's
        if mark and name not in BLOCKS and not off:
            flush()
        stack.push(name, paths.below(here, name, bool(mark)) if name in BLOCKS or mark else here)
        if not off and never:
            off = len(stack.names)
    pop(0)
    if not off:
        flush()
    return found, paths


def without_forms(found: list[tuple[str, int, int]], paths: Paths) -> list[tuple[str, int, int]]:
    """The blocks that aren't in forms. A form that holds an article or main, or half of the page's text or more and a passage in
    it, is layout, not a form."""
    size, passage = [0] * len(paths.forms), [False] * len(paths.forms)
    for text, path, links in found:
        form = paths.form[path]
        size[form] += len(text) - min(links, len(text))
        passage[form] |= len(text) - links >= PASSAGE and bool(PUNCTUATION.search(text))
    layout = [k == 0 or paths.forms[k] or passage[k] and 2 * size[k] >= sum(size) for k in range(len(size))]
    return [b for b in found if layout[paths.form[b[1]]]]


def select(found: list[tuple[str, int, int]], paths: Paths) -> list[str]:
    """The texts of content blocks."""
    found = without_forms(found, paths)
    stats: dict[int, list[float]] = {}
    for text, path, links in found:
        s = stats.setdefault(path, [0, 0, 0, 0])
        for k, v in enumerate((len(text), len(PUNCTUATION.findall(text)), min(links, len(text)), 1)):
            s[k] += v
    if not stats:
        return []
    # ratios of a path, without its link text
    ratio = {p: ((s[0] - s[2]) / s[3], s[1] / s[3] * (1 - s[2] / s[0])) for p, s in stats.items()}
    beside: dict[int, list[float]] = {}
    for p, (text, marks) in ratio.items():
        if not paths.marked[p]:
            b = beside.setdefault(paths.parent[p], [0, 0.0, 0.0])
            b[0], b[1], b[2] = b[0] + 1, b[1] + text, b[2] + marks

    def fused(p: int) -> float:
        text, marks = ratio[p]
        n, texts, all_marks = beside.get(paths.parent[p], (0, 0.0, 0.0))
        if not paths.marked[p] and n > 1:
            text, marks = text + BESIDE * (texts - text) / (n - 1), marks + BESIDE * (all_marks - marks) / (n - 1)
        return math.log1p(text) * math.log1p(marks)

    # the best path is chosen with its share of the page, so that one long notice doesn't outdo an article of short paragraphs;
    # others are held against its ratios alone, since a lead or a small section is content however long the body is
    own = {p: s[0] - s[2] for p, s in stats.items()}
    plain = sum(n for p, n in own.items() if not paths.marked[p])
    fine = {p for p in stats if not paths.marked[p]} if plain and plain >= MARKED * sum(own.values()) else set(stats)
    score = {p: fused(p) for p in fine}
    total = {p: score[p] * math.sqrt(own[p]) for p in fine}
    best = max(sorted(fine), key=lambda p: (total[p], stats[p][0]))
    unlinked = {p for p in fine if stats[p][2] <= LINKS * stats[p][0]}
    if total[best] <= 0:
        return [t for t, p, _ in found if p in unlinked]
    # an article around the best path is its container, else what holds it
    line = paths.above(best)
    place = next((i for i, p in enumerate(line) if paths.name[p] in ("article", "main")), len(line) - 2)
    container, over_it = (line[place] if place >= 0 else 0), {0, *line[: max(place, 0)]}
    held = [False] * len(paths.name)  # within the container
    if container and paths.name[container] not in ("html", "body"):
        held[container] = True
        for p in range(container + 1, len(held)):
            held[p] = held[paths.parent[p]]
    content = {p for p in unlinked if score[p] >= KEEP * score[best]}
    keep = {p for p in fine if held[p]} | content
    if any(held[p] for p in fine) and any(paths.name[p] == "article" for p in line[: place + 1]):
        keep = {p for p in keep if in_article(paths, p)}
    else:
        # what stands beside content paths is content, and so are headings over the container and what else its parents hold
        holders = {paths.parent[p] for p in content} | {container}
        over = {p for p in unlinked if p and paths.parent[p] in over_it}
        keep |= {p for p in unlinked if paths.parent[p] in holders} | {p for p in over if paths.name[p] in HEADINGS or score[p] > 0 and paths.name[paths.parent[p]] not in ("", "html", "body")}
    return [t for t, p, _ in found if p in keep]


def in_article(paths: Paths, path: int) -> bool:
    while path and paths.name[path] != "article":
        path = paths.parent[path] if paths.inside[path] else 0
    return bool(path)


def main_text(page: str | None) -> str:
    """The main text of a page; empty for null, empty or textless pages."""
    return "\n".join(select(*blocks(page))) if page else ""


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages without column, with text and n_chars (code points)."""
    keys = pages.drop(column, "text", "n_chars")
    names = list(keys.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "_html"):
            texts = [main_text(x.as_py()) for x in batch.column("_html")]
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema.fields)
    return pages.select(*names, pages[column].alias("_html")).mapInArrow(run, f"{columns}, text string, n_chars long")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
