"""Main text of web pages by consensus host paths.

1. Every page is read once into text blocks below a tree of elements; menus, headers, footers, sidebars,
   notices, adverts, forms, scripts, styles and comments are marked by tag, role and class words. Class words
   and forms count only while the element holds less of the page's text outside links than a share (`SHARES`).
   The containers that are left are scored by the text that they hold outside links; repeated containers below
   one that has text of its own leave their score to it.
2. A container is named by its generalised path: tags with their classes, digits replaced. Each page
   gives its containers votes in proportion to their scores; a grouped sum over (host, path), combined
   before the shuffle, finds the path with most votes of every host.
3. Every page is read again with its host's path: the blocks of all containers on that path, in page
   order, are the text. A page that has no such container, or no text in it, uses its own best one.

Pages meet their host's path in a join salted by page, so a host that owns a third of all pages is
spread over `SALTS` keys. Only one path for each host is joined.

Defined cases: null or empty html gives the empty text; an address that is null or has no host belongs to
the host ''; ties between paths go to the smaller path; repeated rows vote and are extracted each; an
empty table gives an empty result; very long pages are read whole; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, steps, texts_of

SALTS = 32

# Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea noscript iframe svg title select option".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article main section div td body center blockquote".split())
ASIDE_TAGS = frozenset("aside button dialog footer form head header label legend menu nav".split())
ASIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
ASIDE_WORDS = re.compile(
    r"(?:ads?|advert\w*|banner|breadcrumbs?|captcha|comments?\w*|consent|cookies?|copyright|disclaimer|disqus|feedback|footer|gdpr|header|hidden"
    r"|legal|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notification|overlay|pager|pagination|popup|promos?|promotion"
    r"|recommended|related|replies|reply|respond|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|subscription|tags|toolbar|widget)")
#: Words of reader comments, which are an aside however much they hold.
COMMENT_WORDS = re.compile(r"comments?\w*|disqus|repl(?:y|ies)|respond")
#: First words of class names that tell what a page has or lacks, not what the element is.
ABOUT = frozenset("has with without no not is".split())
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
#: An open element that a new one of the second group ends.
ENDED_BY = {
    "p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    **{f"h{k}": {f"h{n}" for n in range(1, 7)} | {"p"} for k in range(1, 7)},
}

#: Below these shares of the page's text an element is an aside: named by a whole class word; by a part of one, or a form.
SHARES = (0.9, 0.5)

_markup = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^>]*+(?:>|\Z))", re.S)
_attribute = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_word = re.compile(r"[a-z]+|[A-Z][a-z]*")
_digits = re.compile(r"\d+")


class Page:
    """Elements (parent, name, whether aside, weight as a container) and text blocks (element, text, characters in links)."""

    def __init__(self, html: str) -> None:
        self.nodes: list[tuple[int, str, bool, float]] = [(-1, "", False, 1.0)]
        self.blocks: list[tuple[int, str, int]] = []
        self._doubts: dict[int, float] = {}
        self._read(html)
        self._decide()

    def _doubt(self, tag: str, tokens: list[str], in_content: bool) -> float:
        """The share of the page's text below which the element's names make it an aside; 0: they do not."""
        share = SHARES[1] if tag == "form" else 0.0
        for token in tokens:
            words = [w.lower() for w in _word.findall(token)]
            if not words or words[0] in ABOUT or not any(ASIDE_WORDS.fullmatch(w) for w in words):
                continue
            if "header" in words and (in_content or CONTENT_WORDS.intersection(words)):
                continue
            if tag not in ("article", "main") and any(COMMENT_WORDS.fullmatch(w) for w in words):
                return 2.0
            share = max(share, SHARES[len(words) > 1 or tag in ("article", "main")])
        return share

    def _open(self, parent: int, tag: str, attributes: str, in_content: bool) -> None:
        values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _attribute.finditer(attributes)} if "=" in attributes else {}
        classes = values.get("class", "").split()
        aside = (
            tag in ASIDE_TAGS and tag != "form" and not (tag == "header" and in_content)
            or values.get("role", "").lower() in ASIDE_ROLES
            or values.get("aria-hidden") == "true"
            or "display:none" in values.get("style", "").replace(" ", "").lower()
            or re.search(r"(?:^|\s)hidden(?:\s|/|$)", attributes) is not None)
        tokens = [*classes, *values.get("id", "").split()]
        words = {w.lower() for w in _word.findall(" ".join(tokens))}
        if not aside and tag not in ("body", "html") and (doubt := self._doubt(tag, tokens, in_content)):
            self._doubts[len(self.nodes)] = doubt
        weight = 3.0 if tag in ("article", "main") or values.get("itemprop") == "articleBody" else 1.5 if CONTENT_WORDS.intersection(words) else 1.0
        name = ".".join([tag, *sorted(_digits.sub("#", c) for c in classes)])
        self.nodes.append((parent, name, aside, weight if tag in CONTAINERS else 0.0))

    def _decide(self) -> None:
        """Doubtful elements by their share of the text; what stands below an aside is one."""
        held = [0] * len(self.nodes)
        for node, text, linked in self.blocks:
            held[node] += max(0, len(text) - linked)
        for n in range(len(self.nodes) - 1, 0, -1):
            if not self.nodes[n][2]:
                held[self.nodes[n][0]] += held[n]
        for n in range(1, len(self.nodes)):
            parent, name, aside, weight = self.nodes[n]
            aside = aside or self.nodes[parent][2] or n in self._doubts and held[n] < self._doubts[n] * held[0]
            self.nodes[n] = (parent, name, aside, weight)

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]
        text: list[str] = []
        linked = links = 0

        def flush() -> None:
            nonlocal linked
            if text:
                line = " ".join(unescape("".join(text)).split())
                if line:
                    self.blocks.append((stack[-1][1], line, linked))
                text.clear()
            linked = 0

        at, end = 0, len(html)
        while at < end:
            mark = html.find("<", at)
            found = _markup.match(html, mark) if mark >= 0 else None
            while mark >= 0 and not found:
                mark = html.find("<", mark + 1)
                found = _markup.match(html, mark) if mark >= 0 else None
            stop = mark if found else end
            if stop > at:
                text.append(html[at:stop])
                linked += (stop - at) * (links > 0)
            if not found:
                break
            at, tag = found.end(), (found[2] or "").lower()
            if not tag:
                continue
            if found[1]:
                if tag == "a":
                    links = max(0, links - 1)
                if tag in BLOCKS:
                    flush()
                    depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
                    if depth:
                        del stack[depth:]
                        links = 0
                continue
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at) if not found[0].endswith("/>") else None
                at = close.end() if close else at if found[0].endswith("/>") else end
                text.append(" ")
            elif tag == "a":
                links += 1
            elif tag not in BLOCKS:
                if tag == "br":
                    text.append(" ")
            else:
                flush()
                while len(stack) > 1 and tag in ENDED_BY.get(stack[-1][0], ()):
                    stack.pop()
                if tag not in VOID:
                    links = 0
                    self._open(stack[-1][1], tag, found[3], any(t in ("article", "main") for t, _ in stack))
                    stack.append((tag, len(self.nodes) - 1))
        flush()

    def path(self, node: int) -> str:
        names = []
        while node > 0:
            names.append(self.nodes[node][1])
            node = self.nodes[node][0]
        return ">".join(reversed(names))

    def container(self, node: int) -> int:
        while node > 0 and not self.nodes[node][3]:
            node = self.nodes[node][0]
        return node

    def scores(self) -> dict[int, float]:
        """Text outside links for each container, half of it for the container around it; the weight is the element's."""
        out: dict[int, float] = {}
        for node, text, linked in self.blocks:
            value = float(len(text) - 2 * linked)
            if self.nodes[node][2] or value <= 0:
                continue
            for share in (1.0, 0.5, 0.25):
                node = self.container(node)
                out[node] = out.get(node, 0.0) + share * value * self.nodes[node][3]
                if node <= 0:
                    break
                node = self.nodes[node][0]
        return self._gathered(out)

    def _gathered(self, scores: dict[int, float]) -> dict[int, float]:
        """Containers of one name below one that has blocks of its own are its sections: their scores are its own."""
        direct = {self.container(node) for node, text, linked in self.blocks if not self.nodes[node][2] and len(text) > 2 * linked}
        alike: dict[tuple[int, str], list[int]] = {}
        for n in scores:
            parent = self.container(self.nodes[n][0]) if n else 0
            if parent and parent in direct and self.nodes[n][3] < 3:
                alike.setdefault((parent, self.nodes[n][1]), []).append(n)
        # Inner sections first: what they leave goes on with their container.
        for (parent, _), own in sorted(alike.items(), reverse=True):
            if len(own) > 1:
                scores[parent] = scores.get(parent, 0.0) + sum(scores.pop(n) for n in own)
        return scores

    def text(self, path: str | None) -> str:
        """Blocks of the containers on the path; of the page's best container if there is none or it is empty."""
        wanted = {n for n in range(1, len(self.nodes)) if self.nodes[n][3] and self.path(n) == path} if path is not None else set()
        lines = self._inside(wanted)
        if not lines:
            scores = self.scores()
            if scores:
                best = self.path(max(scores, key=lambda n: (scores[n], -n)))
                lines = self._inside({n for n in scores if self.path(n) == best})
        return "\n\n".join(lines)

    def _inside(self, wanted: set[int]) -> list[str]:
        if not wanted:
            return []
        inside = [n in wanted for n in range(len(self.nodes))]
        for n in range(1, len(self.nodes)):
            inside[n] = inside[n] or inside[self.nodes[n][0]]
        return [t for n, t, _ in self.blocks if inside[n] and not self.nodes[n][2]]


def with_host(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"), host.alias("host"))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the generalised path with most votes of each host, from (host, html)."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "html"):
                votes: dict[tuple[str, str], int] = {}
                for host, html in zip(part.column("host").to_pylist(), texts_of(part, "html")):
                    page = Page(html)
                    scores = page.scores()
                    total = sum(scores.values())
                    for node, score in scores.items():
                        at = (host, page.path(node))
                        votes[at] = votes.get(at, 0) + round(1000 * score / total)
                hosts, paths = zip(*votes) if votes else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes.values(), pa.int64())], names=["host", "path", "votes"])

    counted = in_arrow(pages.select("host", "html"), vote, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    first = F.struct((-F.col("votes")).alias("v"), F.col("path").alias("path"))
    return counted.groupBy("host").agg(F.min(first).alias("best")).select("host", F.col("best.path").alias("path"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", salts: int = SALTS) -> DataFrame:
    """key, url, text and n_chars of every page."""
    source = with_host(pages, key, url, html)
    paths = host_paths(source).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = source.withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.lit(salts)).cast("int"))
    joined = salted.join(paths, ["host", "salt"], "left").select("key", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "html"):
                texts = [Page(h).text(p) for h, p in zip(texts_of(part, "html"), part.column("path").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))],
                    names=[key, url, "text", "n_chars"])

    types = {c: joined.schema[c].dataType.simpleString() for c in ("key", "url")}
    return in_arrow(joined, run, f"`{key}` {types['key']}, `{url}` {types['url']}, text string, n_chars long")
