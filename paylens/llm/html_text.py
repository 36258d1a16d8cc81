"""Main text of HTML pages by two passes of block rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Elements by what they mean for text.
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video select option textarea button datalist".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
ASIDE = frozenset("nav header footer aside form menu dialog fieldset".split())
BREAKING = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# An opening tag of the first kind ends an open paragraph.
ENDS_PARAGRAPH = BREAKING - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary"}
STOP_WORDS = frozenset(
    """a about after all also an and are as at be been but by can for from had has have he her his how i if in into is it its me my no not of on one or our out she so than that the their them
    there they this to up us was we were what when which who will with you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die du ein eine einem einen einer es für hat ich ihr im in ist ja mit nach nicht noch nur oder sich sie sind so über um und uns
    vom von vor war was wenn wie wir zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sur une un vous y
    al como con cual de del donde el ella en era es esta este ha la las le lo los más me mi muy no nos o para pero por que se si sin su sus también un una y ya""".split()
)
BOILERPLATE_NAME = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|byline|comments?(?:list|area)?|consent|cookies?|disqus|footer|gdpr|header|masthead|menu|modal|nav\w*|newsletter|notice|overlay|pagination|popup|promo\w*|related|reply|replies|respond|share|sharing|sidebar|skip|social|sponsor\w*|subscribe|toolbar|widget)(?=$|[\s_-])"
)
# What an article element itself may be called without being the page's article.
SECONDARY_ARTICLE = frozenset("ad advert comment promo related reply sponsored teaser".split())
# Function characters of scripts that are written without spaces; hiragana come from their code range.
FUNCTION_CHARACTERS = frozenset("的了是在和不有我你他她这那个们也就都而及与着或一中上到说要会可之为以于对从被把但没很還这這個們與為於對從這說會沒來时時") | frozenset(map(chr, range(0x3041, 0x3097)))
UNSPACED = re.compile("[\u3040-\u9fff]")
BOILERPLATE_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(/?)(?:>|$)", re.S)
NAMED = re.compile(r"(?is)\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Block:
    """A run of text between block borders."""

    __slots__ = ("article", "aside", "heading", "linked", "main", "parts")

    def __init__(self, article: bool, main: bool, aside: bool, heading: bool):
        self.parts: list[str] = []
        self.linked, self.article, self.main, self.aside, self.heading = 0, article, main, aside, heading

    def text(self) -> str:
        return " ".join(unescape("".join(self.parts)).split())


def is_boilerplate(name: str, attributes: str, in_main: bool) -> bool:
    """Whether an element is no part of the article by its name, role, class or id, or hidden."""
    if name in ASIDE:
        # A header or footer inside the article may hold its heading; forms and menus never do.
        return not (in_main and name == "header")
    if not attributes:
        return False
    for key, *values in NAMED.findall(attributes):
        value = "".join(values)
        key = key.lower()
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key == "class" and name == "article" and SECONDARY_ARTICLE.intersection(value.lower().split()):
            return True
        if key == "role" and value.lower() in BOILERPLATE_ROLE or key in ("class", "id") and name not in ("body", "html", "article", "main") and BOILERPLATE_NAME.search(value):
            return True
    return False


def blocks_of(html: str) -> list[Block]:
    """The page's blocks in order. Broken markup is read as browsers do where it matters: open paragraphs end
    at the next block, tags that close nothing are passed over."""
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # name, in article, in main part, in boilerplate, silent
    out: list[Block] = []
    current: Block | None = None
    links = 0
    article = main = aside = silent = False
    at, end = 0, len(html)

    def add(text: str) -> None:
        nonlocal current
        if silent or not text:
            return
        if current is None:
            if not text.strip():
                return
            heading = any(x[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for x in stack[-4:])
            current = Block(article, main, aside, heading)
            out.append(current)
        current.parts.append(text)
        if links:
            current.linked += len(text.strip())

    def state() -> None:
        nonlocal article, main, aside, silent
        article, main, aside, silent = stack[-1][1:] if stack else (False, False, False, False)

    while at < end:
        match = TAG.search(html, at)
        if match is None:
            add(html[at:])
            break
        add(html[at : match.start()])
        at = match.end()
        if match[2] is None:
            if match[0].startswith("<![CDATA["):
                add(match[0][9:].removesuffix("]]>"))
            continue
        name, closing = match[2].lower(), match[1] == "/"
        if name in BREAKING:
            current = None
        elif name == "br":
            add(" ")
        if closing:
            if name == "a" and links:
                links -= 1
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    state()
                    break
            continue
        if name in VOID:
            continue
        if name in ENDS_PARAGRAPH:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    state()
                    break
                if stack[i][0] in BREAKING:
                    break
        if name == "a":
            links += 1
        if name in RAW:
            close = re.compile(rf"(?i)</{name}\s*>").search(html, at)
            at = close.end() if close else end
            continue
        if match[4]:
            continue
        in_article = article or name == "article"
        in_main = main or in_article or name == "main" or 'role="main"' in match[3]
        stack.append((name, in_article, in_main, aside or is_boilerplate(name, match[3], in_main), silent or name in SILENT))
        state()
    return out


GOOD, BAD, SHORT, DENSE, NEAR_GOOD = "good", "bad", "short", "dense", "near good"
LONG, WIDE = 200, 3


def stop_word_density(text: str) -> float:
    """The share of stop words; in text without spaces that of function characters, doubled, as words there have about two."""
    words = text.lower().split()
    if is_unspaced(text):
        return min(1.0, 2 * sum(c in FUNCTION_CHARACTERS for c in text) / len(text))
    return sum(w.strip(".,;:!?\"'()[]#*$%&|") in STOP_WORDS for w in words) / len(words)


def is_unspaced(text: str) -> bool:
    """Whether most characters are of Chinese or Japanese script (U+3040 to U+9FFF)."""
    return bool(UNSPACED.search(text)) and 2 * len(UNSPACED.findall(text)) > len(text)


def length_of(text: str) -> int:
    """Code points; one of a script without spaces counts as WIDE letters."""
    return len(text) * WIDE if is_unspaced(text) else len(text)


def first_pass(text: str, block: Block, marked: bool, max_link: float = 0.3, short: int = 70, low: float = 0.12, high: float = 0.25) -> str:
    """A label from the block alone: link density, length and stop-word density; all but GOOD and BAD are open.

    In a marked article links are content: paragraphs that are mostly a link and lists of sources stay.
    """
    if block.aside:
        return BAD
    if not marked and block.linked > max_link * len(text):
        return BAD
    if length_of(text) < short:
        return SHORT
    density = stop_word_density(text)
    if density >= high:
        return GOOD if length_of(text) >= LONG or marked else DENSE
    if density >= low:
        return NEAR_GOOD
    # In a marked article even text without stop words (lists, tables, names) is only undecided.
    return SHORT if marked else BAD


def joined(labels: list[str], lengths: list[int]) -> list[str]:
    """Two or more DENSE blocks that no BAD one parts are GOOD if they are LONG together, as paragraphs of one text
    are; the others are NEAR_GOOD."""
    out = [NEAR_GOOD if label == DENSE else label for label in labels]
    run: list[int] = []
    for i, label in enumerate([*labels, BAD]):
        if label == DENSE:
            run.append(i)
        elif label == BAD:
            if len(run) > 1 and sum(lengths[k] for k in run) >= LONG:
                for k in run:
                    out[k] = GOOD
            run = []
    return out


def second_pass(labels: list[str], marked: bool) -> list[str]:
    """Open labels become those of their nearest decided neighbours.

    Both alike, or the only one: that label. Otherwise NEAR_GOOD is good, and SHORT is as the nearer one; at the
    same distance it is bad, unless the page marks its article, where blocks need a reason to go.
    """
    n = len(labels)
    before: list[tuple[int, str] | None] = [None] * n
    after: list[tuple[int, str] | None] = [None] * n
    last = None
    for i in range(n):
        before[i] = last
        if labels[i] in (GOOD, BAD):
            last = (i, labels[i])
    last = None
    for i in range(n - 1, -1, -1):
        after[i] = last
        if labels[i] in (GOOD, BAD):
            last = (i, labels[i])
    out = []
    for i, label in enumerate(labels):
        if label in (GOOD, BAD):
            out.append(label)
            continue
        a, b = before[i], after[i]
        if a and b and a[1] != b[1]:
            nearer = None if label == NEAR_GOOD else a if i - a[0] < b[0] - i else b if b[0] - i < i - a[0] else None
            out.append(nearer[1] if nearer else GOOD if label == NEAR_GOOD or marked else BAD)
        elif a or b:
            out.append((a or b)[1])
        else:
            out.append(GOOD if label == NEAR_GOOD or marked else BAD)
    return out


def main_text(html: str) -> str:
    """The article of a page, one block a line.

    Where the page marks its article (article elements; without those, main), only blocks inside it are judged,
    and neighbours are those inside it; elsewhere all blocks are judged, and headings follow the text below them.
    """
    blocks = [(b, t) for b in blocks_of(html) if (t := b.text())]
    has_article = any(b.article and not b.aside for b, _ in blocks)
    marked = has_article or any(b.main and not b.aside for b, _ in blocks)
    judged = [(b, t) for b, t in blocks if not marked or not b.aside and (b.article if has_article else b.main)]
    first = [first_pass(t, b, marked) for b, t in judged]
    if DENSE in first:
        first = joined(first, [length_of(t) for _, t in judged])
    labels = second_pass(first, marked)
    for i in range(len(judged) - 2, -1, -1):
        if judged[i][0].heading and labels[i] == BAD and first[i] == SHORT and labels[i + 1] == GOOD:
            labels[i] = GOOD
    return "\n".join(t for (_, t), label in zip(judged, labels, strict=True) if label == GOOD)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars per row of pages(page_id, url, html), from the whole html.

    Null html is empty and gives an empty text. Null ids and repeated rows keep rows of their own, an empty
    table gives an empty one, other columns aren't read. Time and memory follow the length of each page;
    nothing is shuffled.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
