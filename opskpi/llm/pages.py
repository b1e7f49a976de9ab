"""Main-text extraction with a site style tree.

The pages of a host are merged into one tree: its nodes are the element paths
(tag, classes and id without digits), and each keeps how its pages present it
(the children's tags) and what they say in it.  The importance of a node is
the larger of two entropies, each relative to that of all pages differing:
of its presentations and of its contents.  A path that looks and reads the
same on most pages of its site is decoration.  The tree is two grouped counts:
nothing of a site is gathered, and a site that holds a third of all pages
only has larger counts.

Each page is then read again with its site's low-importance paths (salted, so
a large site is spread over tasks).  Text is kept from the article (or the
main element, or else the body), without

* elements that never hold prose (scripts, styles, form controls, media),
* page furniture by tag, role, class or id (menus, headers and footers outside
  the article, sidebars, notices, adverts, forms, reader comments),
* hidden elements, and
* paths of low importance - these only where the page names no article, since
  inside one a passage that the site repeats is still the article's.

Outside an article furniture only *marks* a subtree, as surely (a tag, a role or
a name that says nothing else) or possibly furniture (a form, or a name that
has a word of it, like ``with-sidebar``).  An article or main element is never
lost to a mark of its ancestors: a page's articles are those without a mark, or
else whichever of its marked articles and its main element says most.  Without
either, sure furniture goes and possible furniture goes where its path is low.

Inside an article a word in a name is not enough, since headings and sections
are named after what they say (``id='related-work'``).  There a container is
dropped by name if one of its classes, or its id, is as a whole the name of an
advert or the like or of reader comments; under a container whose name merely
has a word of furniture, what the site repeats (a path of low importance) goes.

Character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by one newline in page order; line breaks
(``br``) are white space.

Defined cases: null html is empty text; markup may be cut anywhere (an
unfinished tag or comment is no text, an unfinished reference stays as it
is); pages without a host form no site and have no low paths; sites of fewer
than ``SITE_PAGES`` pages have none either; repeated rows are pages like any
others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opskpi.llm.staging import Staging

C = F.col
#: Pages that a path must stand on before its entropies count, and the importance below which it is decoration.
SITE_PAGES = 8
LOW = 0.15
SALTS = 32

# --- fixed values: HTML vocabulary -------------------------------------------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
NO_PROSE = frozenset(
    "script style template noscript head title svg math iframe object embed applet select option optgroup button input "
    "textarea canvas audio video map datalist noembed noframes xmp meter progress".split())
FURNITURE = frozenset("nav footer aside form menu dialog search".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "legend"}
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
            "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")), "td": ("td th", ("tr", "table")),
            "th": ("td th", ("tr", "table")), "option": ("option", ("select", "datalist"))}
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promos promotion banner "
    "menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars rail footer cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup signin login share sharing social "
    "related recommended recommendations comment comments disqus respond reply replies pagination pager widget widgets "
    "skip toolbar search copyright".split())
#: Whole classes or ids that make a container inside an article furniture, and those of reader comments.
CONTAINERS = frozenset("div span ins ul ol li table figure center iframe".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsored promo promos breadcrumb breadcrumbs sidebar "
    "sidebars popup newsletter signup sharing pagination pager navbar cookie-notice".split())
COMMENT_NAMES = frozenset(
    "comment comments reader-comments user-comments comment-list comments-list comments-area comment-respond disqus_thread "
    "respond replies".split())
#: Inside an article these never count as furniture by a word of their names.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 hgroup p section article blockquote pre".split())
#: Beside a word of furniture these say nothing else; with one of the others a name tells what a page has or lacks.
GENERIC = frozenset(
    "area bar block blocks body bottom box buttons container content desktop footer form group header icons inner item items "
    "left links list main mobile module outer panel posts articles stories right row section site slot top unit wrap wrapper "
    "post article text global primary secondary".split())
TELLING = frozenset("with without no has layout page".split())
OUTSIDE_WORDS = frozenset("header masthead topbar".split())
NOISE_ROLES = frozenset("navigation complementary contentinfo search form dialog alertdialog alert menu menubar toolbar".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+(?:>|\Z)|[^>]*+(?:>|\Z))"
    r"|</[^a-zA-Z][^>]*+(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in RAW}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _names(attrs: dict[str, str]) -> set[str]:
    return {w.lower() for w in _WORDS.findall(attrs.get("class", "") + " " + attrs.get("id", ""))}


def _furniture(tag: str, attrs: dict[str, str]) -> bool:
    """Whether an element inside an article is furniture by a whole class or id."""
    classes = set(attrs.get("class", "").lower().split())
    names = classes | {attrs.get("id", "").lower()}
    if tag in ("section", "article"):
        return bool(classes & COMMENT_NAMES)
    return tag in CONTAINERS and bool(names & (NOISE_NAMES | COMMENT_NAMES))


def _mark(tag: str, role: str, attrs: dict[str, str]) -> int:
    """Whether an element outside an article is surely (2), possibly (1) or not (0) furniture."""
    content = tag in ("article", "main", "body", "html") or role in ("main", "article")
    if content:
        about = _names(attrs) & {"comment", "comments", "reply", "replies", "ad", "ads", "promo", "sponsored", "related"}
        return 2 if about and tag not in ("html", "body", "main") else 0
    if tag == "header" or role == "banner" or (tag in FURNITURE and tag != "form") or (role in NOISE_ROLES and role != "form"):
        return 2
    mark = 1 if tag == "form" or role == "form" else 0
    for name in (*attrs.get("class", "").split(), attrs.get("id", "")):
        words = [w.lower() for w in _WORDS.findall(name)]
        noise = [w for w in words if w in NOISE_WORDS or w in OUTSIDE_WORDS]
        if noise:
            sure = all(w in NOISE_WORDS or w in OUTSIDE_WORDS or w in GENERIC for w in words)
            mark = max(mark, 2 if sure and not TELLING.intersection(words) else 1)
    return mark


class Walk:
    """One pass over a page: the tree's nodes on the way, and the text blocks with where they stand."""

    def __init__(self, page: str):
        #: (path, children's tags, own text) of each path; blocks: (text, in article, in main, path, named as furniture, mark)
        self.style: dict[int, list[str]] = {}
        self.said: dict[int, list[str]] = {}
        self.blocks: list[tuple[str, bool, bool, int, bool, int]] = []
        # an open element: tag, path, dropped, inside article, inside main, a word of furniture in a name within the
        # article, the mark of furniture outside it
        self.stack: list[tuple[str, int, bool, bool, bool, bool, int]] = [("", 0, False, False, False, False, 0)]
        self._run: list[str] = []
        self._run_at: tuple[bool, bool, int, bool, int] | None = None
        self._read(page)
        self._flush()

    def _flush(self) -> None:
        if self._run:
            text = " ".join("".join(self._run).split())
            self._run.clear()
            if text:
                article, main, path, named, mark = self._run_at
                self.blocks.append((text, article, main, path, named, mark))
                self.said.setdefault(path, []).append(text)
        self._run_at = None

    def _text(self, raw: str) -> None:
        top = self.stack[-1]
        if top[2] or not raw:
            return
        if self._run_at is None:
            if raw.isspace():
                return
            self._run_at = (top[3], top[4], top[1], top[5], top[6])
        self._run.append(html.unescape(raw) if "&" in raw else raw)

    def _pop(self, at: int) -> None:
        if any(e[0] in BLOCKS for e in self.stack[at:]):
            self._flush()
        del self.stack[at:]

    def _close(self, names, until=()) -> None:
        """Closes the innermost open element of ``names`` that no element of ``until`` shields."""
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i][0]
            if tag in names:
                self._pop(i)
                return
            if tag in until:
                return

    def _open(self, tag: str, raw: str) -> None:
        if tag in CLOSES_P:
            self._close(("p",), ("table", "td", "th", "button", "article", "section", "div", "li", "blockquote", "body"))
        if tag in SIBLINGS:
            names, until = SIBLINGS[tag]
            self._close(names.split(), until)
        if tag in BLOCKS:
            self._flush()
        _, path, dropped, article, main, named, mark = self.stack[-1]
        self.style.setdefault(path, []).append(tag)
        if tag in VOID:
            if tag == "br":
                self._text(" ")
            return
        if dropped:
            self.stack.append((tag, path, True, article, main, named, mark))
            return
        attrs: dict[str, str] = {}
        for m in _ATTR.finditer(raw):
            attrs.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        role = attrs.get("role", "").lower()
        word = bool(_names(attrs) & NOISE_WORDS)
        dropped = (tag in NO_PROSE or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true"
                   or bool(_HIDDEN.search(attrs.get("style", "")))
                   or (article and (tag in FURNITURE or role in NOISE_ROLES or _furniture(tag, attrs))))
        if not article:
            mark = max(mark, _mark(tag, role, attrs))
        shape = re.sub(r"\d+", "", f"{tag}.{'.'.join(sorted(attrs.get('class', '').split()))}#{attrs.get('id', '')}")
        path = xxhash.xxh3_64_intdigest(shape, path & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
        article = article or (not dropped and (tag == "article" or role == "article"))
        main = main or (not dropped and (tag == "main" or role == "main"))
        named = named or (article and word and tag in BLOCKS and tag not in PROSE)
        self.stack.append((tag, path, dropped, article, main, named, mark))

    def _read(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            m = _TOKEN.search(page, at)
            if m is None:
                self._text(page[at:])
                return
            if m.start() > at:
                self._text(page[at:m.start()])
            at = m.end()
            name = m["name"]
            if name is None:
                continue
            tag = name.lower()
            if m["end"]:
                if tag in ("br", "p") and tag == "br":
                    self._text(" ")
                else:
                    self._close((tag,))
                continue
            attrs = m["attrs"]
            if not attrs.endswith(">"):
                return  # cut inside a tag
            self._open(tag, attrs[:-1])
            if tag in _RAW_END:
                end = _RAW_END[tag].search(page, at)
                if self.stack[-1][0] == tag:
                    self.stack.pop()
                if end is None:
                    return
                at = end.end()

    def text(self, low: frozenset[int] | set[int] = frozenset()) -> str:
        kept = [b for b in self.blocks if b[5] < 2 and b[3] not in low]     # outside articles
        articles = [[b[0] for b in self.blocks if b[1] and b[5] == mark and not (b[4] and b[3] in low)] for mark in range(3)]
        if articles[0]:
            return "\n".join(articles[0])
        told = max(([b[0] for b in kept if b[2]], *articles[1:]), key=lambda own: sum(map(len, own)))
        return "\n".join(told or [b[0] for b in kept])


def _host(url):
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)


def site_paths(pages: DataFrame) -> DataFrame:
    """``(host, path, importance, pages)`` of the merged trees."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                rows = {k: [] for k in ("host", "path", "style", "said")}
                for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    w = Walk(page or "")
                    for path in w.style.keys() | w.said.keys():
                        rows["host"].append(host)
                        rows["path"].append(path)
                        rows["style"].append(xxhash.xxh3_64_intdigest(" ".join(w.style.get(path, ()))) - (1 << 63))
                        said = w.said.get(path)
                        rows["said"].append(xxhash.xxh3_64_intdigest("\n".join(said).encode("utf-8", "surrogatepass"))
                                            - (1 << 63) if said else None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["host"], pa.string()), *(pa.array(rows[k], pa.int64()) for k in ("path", "style", "said"))],
                    names=["host", "path", "style", "said"])

    nodes = pages.where("host != ''").select("host", "html").mapInArrow(
        run, "host string, path long, style long, said long")
    kinds = F.array(F.struct(F.lit("style").alias("kind"), C("style").alias("sig")),
                    F.struct(F.lit("said").alias("kind"), C("said").alias("sig")))
    counts = (nodes.select("host", "path", F.explode(kinds).alias("k")).where("k.sig is not null")
              .groupBy("host", "path", C("k.kind").alias("kind"), C("k.sig").alias("sig")).agg(F.count(F.lit(1)).alias("n")))
    entropy = counts.groupBy("host", "path", "kind").agg(
        F.sum("n").alias("m"), F.sum(C("n") * F.log("n")).alias("s")).withColumn(
        "h", F.when(C("m") > 1, (F.log("m") - C("s") / C("m")) / F.log("m")).otherwise(1.0))
    return entropy.groupBy("host", "path").agg(F.max("h").alias("importance"), F.max("m").alias("pages"))


def main_text(pages: DataFrame, low: float = LOW, site_pages: int = SITE_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages(page_id, url, html)``."""
    part = pages.select(C("page_id").cast("long").alias("page_id"), C("url").cast("string").alias("url"),
                        C("html").cast("string").alias("html")).withColumn("host", _host(C("url")))
    staging = Staging(pages.sparkSession, "pages")
    paths = staging.put(site_paths(part).where((C("importance") < low) & (C("pages") >= site_pages)), "paths")
    lists = paths.groupBy("host").agg(F.collect_list("path").alias("low")).select(
        "host", "low", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = part.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                texts = [Walk(page).text(set(paths or ())) if page else "" for page, paths in
                         zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return salted.join(lists, ["host", "salt"], "left").select("page_id", "url", "html", "low").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
