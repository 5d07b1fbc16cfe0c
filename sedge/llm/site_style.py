"""HTML extraction by site style trees.

The pages of a host are merged into one tree: a node is a path of element names with class or id, and under it stand
the sequences of children (its presentation) and the texts (its content) that pages show there. The importance of
either is the number of effectively different ones, the exponential of their entropy, as a share of the node's pages,
and at least the share of pages that show one of their own: 1 where every page shows something else, near 0 where all
show the same few. A node's importance weighs both; that of a node without children is that of its content.

The trees of all hosts are merged once more: a host with few pages for a node borrows the importance of the same node
there, as if it had HOSTS_PRIOR more pages. Branches of low importance are removed from each page.

Markup enters as a prior. Outside article elements, a branch of a page that has an article is kept only if the tree
says so against OUTSIDE_PRIOR pages to the contrary. Inside them nodes and single texts count as well (the importance of a
text is the share of pages whose node does not show it), as if ARTICLE_PRIOR more pages had shown something else; pages
of a host with the same article count once there, so that copies of an article do not make it boilerplate. Of several
articles the largest decides: those at other places of the page, and much smaller ones, are teasers.

What markup itself declares to be outside the article (menus, headers, footers, sidebars, adverts, forms, comments,
scripts, styles) goes whatever its importance; the header of a section inside an article and a form around the page's
frame stay, and so do forms where a page has nothing else. A class, id or role declares by a whole name (see `declares`), never on
html, body, main or article; above an article it counts only where another article of the page stands free of such
names. With markup=False neither articles nor such declarations are looked at, and the trees alone decide.

Pages are parsed inside tasks, twice: once to count, once to extract. What is shuffled are hashes of nodes and texts,
and counts. Verdicts on nodes are broadcast up to BROADCAST_BYTES, those with the most pages first; beyond that, the
nodes of each page meet the remaining verdicts in a join on (host, node), and pages get theirs by a hash of the page.

Defined results: null and empty pages have the empty text; a page without markup is one block; pages without a host form
one host of their own; repeated rows count and return one by one.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

#: Fixed values of HTML: elements without content, with raw text, that are blocks, and that close an open p.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("script style head title noscript template iframe svg math object select textarea input".split())
OUTSIDE = HIDDEN | frozenset("nav header footer aside form button menu dialog".split())
#: Words in a class, id or role by which markup declares a branch to be outside the article.
OUTSIDE_WORDS = frozenset("ad ads advert advertisement adverts alert aside banner bottombar breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo related replies reply share sharing sidebar sidebars sidenav signup social sponsor sponsored subscribe toolbar topbar widget widgets".split())
TAG = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Parts of names that tell a layout, a state or a part of the content: `has-sidebar`, `entry-header`.
LAYOUT_WORDS = frozenset("article body content entry has have hide is layout main no not page post show single story text title toggle with without".split())
#: Elements that no class word puts outside.
NEVER_DECLARED = frozenset("html body main article".split())
#: Elements of a page's frame, or the end of a form.
FRAME_OR_END = re.compile(r"<(?:(article|main|section|nav|header|footer|aside)\b|/form\b)", re.I)
PARTS = re.compile(r"[^a-z]+")
SPACE = re.compile(r"\s+")
SEED = 11
BROADCAST_BYTES = 16 << 20
LEAST_PAGES = 8
#: Importance below which a branch goes, outside articles and inside them, and from which one beside an article stays.
LEAST_IMPORTANCE, LEAST_INSIDE, BESIDE = 0.5, 0.35, 0.75
#: So many pages more are assumed: those of all hosts, some with something else inside an article, some with the same beside it.
HOSTS_PRIOR, ARTICLE_PRIOR, OUTSIDE_PRIOR = 40, 8, 50
#: Verdicts on a node: low inside an article, low outside one, none, and content even beside an article.
LOW_INSIDE, LOW, OPEN, HIGH = 1, 2, 3, 4
#: Share of the presentation in the importance of a node that has children.
PRESENTATION = 0.1


@dataclass
class Block:
    """A block of text with the node it stands in: hashes of the node's path and of all paths above it.

    around: a name declares an element above the article to be outside. own: where in path the article itself is.
    place: hash of the path of the article. in_form: nothing but a form around it puts it outside.
    """

    text: str
    path: tuple[int, ...]
    outside: bool
    article: int
    around: bool
    own: int
    place: int
    in_form: bool = False

    @property
    def shown(self) -> int:
        """The text as shown in its node."""
        return xxhash.xxh64_intdigest(f"{self.path[-1]}={self.text}".encode("utf-8", "surrogatepass"), SEED)


def declares(name: str) -> bool:
    """Whether a class, id or role says that its element is outside the article: its last part does, and no part tells a layout."""
    parts = [x for x in PARTS.split(name) if x]
    return bool(parts) and parts[-1] in OUTSIDE_WORDS and not any(x in LAYOUT_WORDS for x in parts)


def _names(attributes: str) -> tuple[str, bool]:
    """Class and id for the node's name, and whether they (or the role) declare it outside the article."""
    if not attributes.strip():
        return "", False
    named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    label = " ".join(named.get(k, "") for k in ("class", "id", "role")).lower()
    return re.sub(r"\d+", "0", label.strip()), any(declares(x) for x in label.split())


def wraps(page: str, at: int) -> bool:
    """Whether a form that begins at this place is a wrapper of the page: an element of the page's frame stands in it."""
    found = FRAME_OR_END.search(page, at)
    return bool(found and found[1])


def blocks(page: str | None, children: dict[int, list[str]] | None = None, markup: bool = True) -> list[Block]:
    """The blocks of a page in order. Unclosed and misnested elements are closed where an element around them ends.

    children, if given, gets the sequence of child elements of every node. Without markup, no element is an article or
    declared outside one.
    """
    if not page:
        return []
    out: list[Block] = []
    # Open elements: name, path hash, outside by element (0: no, 1: a form, 2: another), number of the article around (0: none), outside by name, and whether
    # a name declares an element above that article outside.
    stack: list[tuple[str, int, int, int, bool, bool]] = [("", 0, 0, 0, False, False)]
    parts: list[str] = []
    at, n_articles, end = 0, 0, len(page)

    def flush() -> None:
        text = SPACE.sub(" ", html_module.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            _, _, by_element, article, by_name, around = next(x for x in reversed(stack) if x[0] in BLOCKS or not x[0])
            own = sum(x[0] in BLOCKS and not x[3] for x in stack)
            place = next((x[1] for x in stack if x[3]), 0)
            out.append(Block(text, tuple(x[1] for x in stack if x[0] in BLOCKS), bool(by_element) or by_name, article, around, own, place, by_element == 1 and not by_name))

    def add(text: str) -> None:
        """Text of the open block; an element in a line that is declared outside the article is left out."""
        if stack[-1][0] in BLOCKS or not (stack[-1][2] or stack[-1][4]):
            parts.append(text)

    while at < end:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCKS:
                flush()
            if any(x[0] == name for x in stack):
                while stack[-1][0] != name:
                    stack.pop()
                stack.pop()
            continue
        if name == "br":
            parts.append(" ")
        if name in BLOCKS:
            flush()
            # A p ends before the next block; so do cells and items before the next of their kind.
            closes = ("p",) if name != "li" else ("p", "li")
            while len(stack) > 1 and (stack[-1][0] in closes or stack[-1][0] not in BLOCKS and any(x[0] in closes for x in stack[1:])):
                stack.pop()
        if name in VOID or m[3].endswith("/"):
            continue
        label, declared = _names(m[3])
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        _, above, by_element, article, by_name, around = stack[-1]
        if name == "article" and not article and markup:
            n_articles += 1
            article, by_name, around = n_articles, False, by_name
            # A form may hold the whole page.
            by_element = 2 * any(x[0] in OUTSIDE and x[0] != "form" for x in stack)
        declared = declared and markup and name not in NEVER_DECLARED
        path = xxhash.xxh64_intdigest(f"{above}>{name}.{label}", SEED) if name in BLOCKS else above
        if children is not None and path != above:
            children.setdefault(above, []).append(f"{name}.{label}")
        level = 2 * (name in (OUTSIDE if markup else HIDDEN))
        if level and name == "form":
            level = 0 if stack[-1][0] in ("", "html", "body") and wraps(page, at) else 1
        elif level and name == "header" and any(x[0] == "section" and x[3] for x in stack):
            # The heading of an article's section is content; the article's own header (bylines, dates) is not.
            level = 0
        stack.append((name, path, max(by_element, level), article, by_name or declared, around))
    flush()
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def node_counts(pages: DataFrame, markup: bool = True) -> DataFrame:
    """host, node, kind, shown, n: how often pages of the host show a content (kind 0: the texts of the branch, by hash) or
    a presentation (kind 1: the sequence of children) at a node.

    Kinds 2 and 3 are those of articles and of nodes inside them. Kind 4 are single texts there: node is the text at its
    place, and shown the node that shows it. For these kinds n counts different articles rather than pages.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hosts, nodes, kinds, shown, wholes = [], [], [], [], []
            for host, page in zip(batch["host"], batch["html"], strict=True):
                children: dict[int, list[str]] = {}
                texts: dict[int, xxhash.xxh64] = {}
                inside: dict[int, xxhash.xxh64] = {}
                single: dict[int, int] = {}
                whole = xxhash.xxh64(seed=SEED)
                for block in blocks(page, children, markup):
                    if block.outside and (block.article or not markup):
                        continue
                    data, into = block.text.encode("utf-8", "surrogatepass") + b"\n", inside if block.article else texts
                    for node in block.path[block.own :] if block.article else block.path:
                        if node not in into:
                            into[node] = xxhash.xxh64(seed=SEED)
                        into[node].update(data)
                    if block.article:
                        whole.update(data)
                        single[block.shown] = block.path[-1]
                for kind, found in ((0, texts), (2, inside)):
                    shapes = {node: xxhash.xxh64_intdigest(" ".join(names), SEED) for node, names in children.items() if node in found}
                    nodes += [*map(signed, found), *map(signed, shapes)]
                    kinds += [kind] * len(found) + [kind + 1] * len(shapes)
                    shown += [*(signed(h.intdigest()) for h in found.values()), *map(signed, shapes.values())]
                    wholes += [signed(whole.intdigest()) if kind else 0] * (len(found) + len(shapes))
                nodes += map(signed, single)
                kinds += [4] * len(single)
                shown += map(signed, single.values())
                wholes += [signed(whole.intdigest())] * len(single)
                hosts += [host] * (len(nodes) - len(hosts))
            if nodes:
                yield pd.DataFrame({"host": hosts, "node": np.array(nodes, np.int64), "kind": np.array(kinds, np.int32), "shown": np.array(shown, np.int64), "whole": np.array(wholes, np.int64)})

    rows = pages.select("host", "html").mapInPandas(count, "host string, node bigint, kind int, shown bigint, whole bigint")
    articles = rows.groupBy("host", "node", "kind", "shown", "whole").agg(F.count("*").alias("n"))
    return articles.groupBy("host", "node", "kind", "shown").agg(F.sum(F.when(F.col("kind") < 2, F.col("n")).otherwise(1)).alias("n"))


def _importance(counts: DataFrame, keys: list[str], presentation: float) -> DataFrame:
    """keys, m (pages that show the node) and importance, from how often contents (kind 0) and presentations (kind 1) are shown."""
    kinds = counts.groupBy(*keys, "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.count_if(F.col("n") == 1).alias("own"))
    # exp(entropy) / m is exp(-sum(n log n) / m).
    value = F.greatest(F.exp(-F.col("nlogn") / F.col("m")), F.col("own") / F.col("m"))
    of = lambda kind, x: F.max(F.when(F.col("kind") == kind, x))
    both = kinds.groupBy(*keys).agg(of(0, F.col("m")).alias("m"), of(0, value).alias("content"), of(1, value).alias("shape"))
    return both.where("m IS NOT NULL").select(*keys, "m", F.coalesce(F.col("shape") * presentation + F.col("content") * (1 - presentation), "content").alias("importance"))


def importances(counts: DataFrame, presentation: float = PRESENTATION) -> DataFrame:
    """host, node, inside (an article), m (pages that show the node) and importance."""
    known = counts.where("kind < 4").withColumn("inside", F.col("kind") >= 2).withColumn("kind", F.col("kind") % 2)
    return _importance(known, ["host", "node", "inside"], presentation)


def verdicts(counts: DataFrame, least_pages: int = LEAST_PAGES, least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """host, node, m and verdict, as far as there are pages enough to tell.

    A null host holds the verdicts of all hosts' tree, for nodes of which a host has fewer pages; a host's own verdict is
    listed where it differs from that. Texts inside articles have the hash of text and place as their node.
    """
    found = importances(counts)
    outside = counts.where("kind < 2").groupBy("node", "kind", "shown").agg(F.sum("n").alias("n"))
    everywhere = _importance(outside, ["node"], PRESENTATION).where(F.col("m") >= least_pages).select("node", F.col("m").alias("m_all"), F.col("importance").alias("all"))
    judge = lambda m, x: F.when(x < least_importance, LOW).when(x * m / (m + OUTSIDE_PRIOR) >= BESIDE, HIGH).otherwise(OPEN)
    general = everywhere.select("node", "m_all", "all", judge(F.col("m_all"), F.col("all")).alias("general"))
    own = found.where(~F.col("inside") & (F.col("m") >= least_pages)).join(general, "node", "left")
    prior = F.when(F.col("all").isNull(), 0).otherwise(HOSTS_PRIOR)
    blended = (F.col("importance") * F.col("m") + F.coalesce("all", F.lit(0.0)) * prior) / (F.col("m") + prior)
    own = own.withColumn("verdict", judge(F.col("m"), blended)).where(F.col("verdict") != F.coalesce("general", F.lit(OPEN))).select("host", "node", "m", "verdict")
    texts = counts.where((F.col("kind") == 4) & (F.col("n") >= least_pages)).select("host", F.col("node").alias("text"), F.col("shown").alias("node"), "n")
    texts = texts.join(found.where("inside").select("host", "node", "m"), ["host", "node"]).select("host", F.col("text").alias("node"), "m", (1 - F.col("n") / F.col("m")).alias("importance"))
    within = found.where("inside").select("host", "node", "m", "importance").unionByName(texts).where(F.col("m") >= least_pages)
    within = within.where((F.col("importance") * F.col("m") + ARTICLE_PRIOR) / (F.col("m") + ARTICLE_PRIOR) < LEAST_INSIDE).select("host", "node", "m", F.lit(LOW_INSIDE).alias("verdict"))
    general = general.where(F.col("general") != OPEN).select(F.lit(None).cast("string").alias("host"), "node", F.col("m_all").alias("m"), F.col("general").alias("verdict"))
    return own.unionByName(within).unionByName(general).withColumn("verdict", F.col("verdict").cast("tinyint"))


def candidates(found: list[Block]) -> list[Block]:
    """The blocks that markup does not put outside; those in forms where a page has no others."""
    return [b for b in found if not b.outside] or [b for b in found if b.in_form]


def nodes_of(found: list[Block]) -> set[int]:
    """The nodes and texts whose verdicts extract() asks for."""
    return {signed(x) for b in candidates(found) for x in ((*b.path[b.own + 1 :], b.shown) if b.article else b.path)}


def extract(found: list[Block], verdict: dict[int, int]) -> str:
    """The text of a page's main article, of the whole page where it has none, by the verdicts on its nodes."""
    kept = candidates(found)
    articles = [b for b in kept if b.article]
    chosen = [b for b in articles if not b.around] or articles
    of = lambda nodes: [verdict.get(signed(x), OPEN) for x in nodes]
    if chosen:
        chosen = [b for b in chosen if LOW_INSIDE not in of((*b.path[b.own + 1 :], b.shown))]
        size: Counter = Counter()
        for b in chosen:
            size[b.place, b.article] += len(b.text)
        place = max(size, key=lambda x: size[x], default=(0, 0))[0]
        # Ancestors of an article tell nothing about what stands beside it.
        above = {x for b in articles for x in b.path[: b.own]}
        beside = {id(b) for b in kept if not b.article and (own := [x for x in b.path if x not in above]) and set(of(own)) == {HIGH}}
        inside = {id(b) for b in chosen if b.place == place}
        return "\n".join(b.text for b in kept if id(b) in beside or id(b) in inside)
    return "\n".join(b.text for b in kept if LOW not in of(b.path))


class Verdicts:
    """Verdicts by host: sorted nodes and their values, for broadcasting."""

    def __init__(self, rows: pd.DataFrame):
        columns = lambda part: (part["node"].to_numpy(np.int64), part["verdict"].to_numpy(np.int8))
        rows = rows.sort_values("node")
        self.general = columns(rows[rows["host"].isna()])
        self.hosts = {host: columns(part) for host, part in rows[rows["host"].notna()].groupby("host", sort=False)}

    def of(self, host: str, nodes: set[int]) -> dict[int, int]:
        out: dict[int, int] = {}
        asked = np.fromiter(nodes, np.int64, len(nodes))
        for known, values in (self.general, self.hosts.get(host, ((), ()))):
            if len(known):
                at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                hit = known[at] == asked
                out.update(zip(asked[hit].tolist(), values[at[hit]].tolist(), strict=True))
        return out


def with_text(pages: DataFrame, name: str, *, url: str = "url", html: str = "html", least_pages: int = LEAST_PAGES, least_importance: float = LEAST_IMPORTANCE, broadcast_bytes: int = BROADCAST_BYTES, markup: bool = True) -> DataFrame:
    """pages with one more column, their main text. The name must be new: no column is replaced."""
    if fresh(pages.columns, name)[0] != name:
        raise ValueError(f"there is a column {name} already")
    spark = pages.sparkSession
    host = F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url}`"), r"^[a-zA-Z][-+.a-zA-Z0-9]*://([^/?#]*)", 1)), F.lit(""))
    host_name, found_name, key_name, key_2 = fresh([*pages.columns, name], "host", "found", "key", "key_2")
    hosted = pages.withColumn(host_name, host)
    parts = hosted.select(F.col(host_name).alias("host"), F.col(f"`{html}`").alias("html"))
    counts = cut(node_counts(parts, markup))
    judged = cut(verdicts(counts, least_pages, least_importance))
    size = F.coalesce(F.octet_length("host"), F.lit(0)) + 24
    total = judged.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    hot = judged
    if total["bytes"] > broadcast_bytes:
        # As many of the nodes with the most pages as fit; the rest have few pages each and are joined.
        least = judged.agg(F.percentile_approx("m", 1 - broadcast_bytes / total["bytes"], 10_000)).first()[0]
        hot = judged.where(F.col("m") > least)
        if hot.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] > broadcast_bytes:
            least, hot = None, judged.limit(0)
    held = spark.sparkContext.broadcast(Verdicts(hot.select("host", "node", "verdict").toPandas()))

    if hot is judged:

        @F.pandas_udf("string")
        def main_text(hosts: pd.Series, htmls: pd.Series) -> pd.Series:
            out = []
            for x, h in zip(hosts, htmls, strict=True):
                found = blocks(h, markup=markup)
                out.append(extract(found, held.value.of(x, nodes_of(found))))
            return pd.Series(out, dtype=object)

        return hosted.withColumn(name, main_text(F.col(host_name), F.col(f"`{html}`"))).drop(host_name)

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k1, k2, x, h in batch.itertuples(index=False):
                nodes = list(nodes_of(blocks(h, markup=markup)))
                yield pd.DataFrame({"k1": [k1] * len(nodes), "k2": [k2] * len(nodes), "host": [x] * len(nodes), "node": np.array(nodes, np.int64)})

    @F.pandas_udf("string")
    def main_text_of(hosts: pd.Series, own: pd.Series, htmls: pd.Series) -> pd.Series:
        out = []
        for x, pairs, h in zip(hosts, own, htmls, strict=True):
            found = blocks(h, markup=markup)
            verdict = held.value.of(x, nodes_of(found))
            # All hosts' verdicts come first, so that the host's own replace them.
            for p in sorted(() if pairs is None else pairs, key=lambda p: not p["general"]):
                if not (p["general"] and p["node"] in verdict):
                    verdict[p["node"]] = p["verdict"]
            out.append(extract(found, verdict))
        return pd.Series(out, dtype=object)

    key = [F.xxhash64("host", "html"), F.xxhash64("html", F.lit(1), "host")]
    cold = judged if least is None else judged.where(F.col("m") <= least)
    nodes = parts.select(key[0].alias("k1"), key[1].alias("k2"), "host", "html").where("html IS NOT NULL").dropDuplicates(["k1", "k2"]).mapInPandas(asked, "k1 bigint, k2 bigint, host string, node bigint")
    own = nodes.join(cold.where("host IS NOT NULL"), ["host", "node"]).select("k1", "k2", "node", "verdict", F.lit(False).alias("general"))
    general = nodes.join(cold.where("host IS NULL").drop("host"), "node").select("k1", "k2", "node", "verdict", F.lit(True).alias("general"))
    by_page = own.unionByName(general).groupBy("k1", "k2").agg(F.collect_list(F.struct("node", "verdict", "general")).alias(found_name)).withColumnsRenamed({"k1": key_name, "k2": key_2})
    keyed = hosted.withColumns({key_name: F.xxhash64(host_name, F.col(f"`{html}`")), key_2: F.xxhash64(F.col(f"`{html}`"), F.lit(1), host_name)})
    joined = keyed.join(by_page, [key_name, key_2], "left")
    return joined.withColumn(name, main_text_of(F.col(host_name), F.col(found_name), F.col(f"`{html}`"))).select(*[F.col(f"`{c}`") for c in pages.columns], name)


def report(pages: DataFrame, **options) -> DataFrame:
    found = with_text(pages.select("page_id", "url", "html"), "main_text", **options)
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))
