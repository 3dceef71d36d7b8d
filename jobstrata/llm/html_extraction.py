"""Main text of web pages by boosted trees over the nodes of the document tree."""

import random
import re
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from jobstrata.llm import arrays
from jobstrata.llm.boosting import Boosted

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
             "strong sub sup time tt u var".split())
HIDDEN = {"script", "style", "noscript", "template", "title", "head", "svg", "math", "iframe", "object", "select", "textarea"}
#: Tags that do not end an open head.
HEAD = {"html", "head", "title", "style", "script", "noscript", "template", "meta", "link", "base", "basefont", "bgsound", "noframes"}
#: Tags that end an open paragraph or an open tag of their own kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
LISTS = {"ul", "ol", "dl", "table"}

TAGS = ["#run", "p", "h1", "h2", "li", "ul", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form",
        "table", "td", "blockquote", "pre", "figure", "body"]
GOOD = set("article articles content contents post entry main body story text page prose paragraph hentry".split())
POOR = set("nav navbar navigation menu header masthead head footer foot sidebar side aside ad ads advert advertisement advertising "
           "banner promo sponsor sponsored cookie cookies consent notice notices alert popup modal overlay form search login "
           "signup subscribe newsletter comment comments reply replies respond disqus discussion share sharing social related "
           "recommended breadcrumb breadcrumbs pagination pager widget copyright legal disclaimer toolbar tags meta gdpr".split())
GOOD_TAGS, POOR_TAGS = {"article", "main"}, {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu"}

#: The marked sections that the standard parser knows; it gives up at others.
SECTION = re.compile(r"<!\[(temp|cdata|ignore|include|rcdata|if|else|endif)(?![-_.a-z0-9])", re.IGNORECASE)
TOKEN, STOPS = re.compile(r"[a-z]+"), re.compile(r"[.!?;:,]")


class Tree(HTMLParser):
    """Block elements and text runs of a page, in page order; inline elements belong to the run around them.

    parent, tag, tokens and text describe the nodes; only runs have text. Links are counted by characters.
    """

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.tokens, self.text, self.links = [-1], ["body"], [()], [None], [0]
        self.open, self.names, self.run, self.hidden, self.anchors = [0], ["body"], None, 0, 0
        self.stack = []  # open tags below the body: (name, is a block)
        self.feed(html)
        self.close()
        self.text = [None if t is None else " ".join("".join(t).split()) for t in self.text]

    def parse_marked_section(self, i, report=1):
        """Markup that opens with `<![`: what names no known section is a comment up to the next `>`, as in browsers."""
        if SECTION.match(self.rawdata, i):
            return super().parse_marked_section(i, report)
        return self.rawdata.find(">", i) + 1 or -1

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD:
            self._leave_head(tag == "body")
        if tag in HIDDEN:
            self.hidden += 1
            self.stack.append((tag, None))
            return
        if tag in VOID:
            if tag in ("br", "hr") and self.run is not None:
                self.text[self.run].append(" ")
            return
        if tag in ("html", "body"):
            return
        if tag in INLINE:
            self.anchors += tag == "a"
            self.stack.append((tag, False))
            return
        self._imply(tag)
        words = " ".join(v for k, v in attrs if k in ("class", "id", "role", "itemprop", "aria-label") and v).lower()
        self._node(tag, tuple(TOKEN.findall(words)))
        self.open.append(len(self.tag) - 1)
        self.stack.append((tag, True))
        self.run = None

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("html", "body"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "p" and not any(name == "p" for name, _ in self.stack):
            self.run = None
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                self._close(at)
                return
            if self.stack[at][1] and tag in INLINE:
                return

    def handle_data(self, data):
        if self.hidden and data.strip():
            self._leave_head(False)
        if self.hidden:
            return
        if self.run is None:
            if not data.strip():
                return
            self._node("#run", ())
            self.text[-1] = []
            self.run = len(self.tag) - 1
        self.text[self.run].append(data)
        if self.anchors:
            self.links[self.run] += len(data)

    def _node(self, tag, tokens):
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.tokens.append(tokens)
        self.text.append(None)
        self.links.append(0)

    def _leave_head(self, body):
        """Ends an open head, whose end tag may be missing; inside an element of it only at the start of the body."""
        if self.hidden and self.stack[-1][0] == "head":
            self._close(len(self.stack) - 1)
        elif self.hidden and body and [name for name, _ in self.stack[-2:]] == ["head", "noscript"]:
            self._close(len(self.stack) - 2)

    def _imply(self, tag):
        ends = CLOSES.get(tag, ())
        for at in range(len(self.stack) - 1, -1, -1):
            name = self.stack[at][0]
            if name == "p" or name in ends:
                self._close(at)
                if name in ends:
                    return
            elif name in LISTS or (self.stack[at][1] and not ends):
                return

    def _close(self, at):
        for name, block in self.stack[at:]:
            if block:
                self.open.pop()
                self.run = None
            elif block is None:
                self.hidden -= 1
            elif name == "a":
                self.anchors -= 1
        del self.stack[at:]


def features(tree):
    """One row of numbers for every node: tag, depth, density of text and links, attribute tokens, siblings, place."""
    count = len(tree.tag)
    parent = tree.parent
    chars, words, marks, upper = ([0] * count for _ in range(4))
    links, runs, nodes, kids, depth = list(tree.links), [0] * count, [1] * count, [0] * count, [0] * count
    own_good, own_poor = [0] * count, [0] * count
    near_good, near_poor = [0] * count, [0] * count
    for v in range(count):
        text = tree.text[v]
        if text is not None:
            chars[v], words[v], runs[v] = len(text), text.count(" ") + 1, 1
            marks[v] = len(STOPS.findall(text))
            upper[v] = sum(map(str.isupper, text))
        tag, tokens = tree.tag[v], tree.tokens[v]
        own_good[v] = (tag in GOOD_TAGS) + sum(t in GOOD for t in tokens)
        own_poor[v] = (tag in POOR_TAGS) + sum(t in POOR for t in tokens)
        if v:
            p = parent[v]
            depth[v] = depth[p] + 1
            kids[p] += 1
            near_good[v], near_poor[v] = own_good[v] or 0.7 * near_good[p], own_poor[v] or 0.9 * near_poor[p]
    before, seen = [0] * count, 0
    for v in range(count):
        before[v] = seen
        seen += chars[v] if tree.text[v] is not None else 0
    for v in range(count - 1, 0, -1):
        p = parent[v]
        chars[p] += chars[v]
        words[p] += words[v]
        marks[p] += marks[v]
        upper[p] += upper[v]
        links[p] += links[v]
        runs[p] += runs[v]
        nodes[p] += nodes[v]
    total = max(1, chars[0])
    last, number = {}, [0] * count
    previous, following = [-1] * count, [-1] * count
    for v in range(1, count):
        p = parent[v]
        if p in last:
            previous[v], following[last[p]] = last[p], v
            number[v] = number[last[p]] + 1
        last[p] = v
    out = np.zeros((count, 24 + len(TAGS)))
    for v in range(count):
        p, n = max(parent[v], 0), max(chars[v], 1)
        around = [u for u in (previous[v], following[v]) if u >= 0]
        out[v, :24] = (
            depth[v], kids[v], runs[v], np.log1p(chars[v]), np.log1p(words[v]), links[v] / n, marks[v] / max(words[v], 1),
            upper[v] / n, n / nodes[v], chars[v] / max(runs[v], 1), chars[v] / total, before[v] / total,
            own_good[v], own_poor[v], near_good[v], near_poor[v], near_good[p], near_poor[p],
            number[v] / max(kids[p], 1), kids[p], (chars[p] - chars[v]) / max(kids[p] - 1, 1),
            sum(links[u] / max(chars[u], 1) for u in around) / max(len(around), 1),
            sum(own_poor[u] for u in around), sum(own_good[u] for u in around))
        tag = tree.tag[p] if tree.tag[v] == "#run" else tree.tag[v]
        if tag in TAGS:
            out[v, 24 + TAGS.index(tag)] = 1
        if tree.tag[v] == "#run":
            out[v, 24] = 1
    return out


def decode(tree, content, boilerplate):
    """Whether each run is main text: the best choice of content, boilerplate or mixed for all nodes together.

    What is below a content node is content, what is below a boilerplate node is boilerplate; only mixed nodes
    leave the choice to their children, and runs are never mixed.
    """
    count = len(tree.tag)
    soft = np.logaddexp(0, -np.stack([content, boilerplate]))
    hard = np.logaddexp(0, np.stack([content, boilerplate]))
    keep, drop = -soft[0] - hard[1], -hard[0] - soft[1]
    mixed = np.where([t is not None for t in tree.text], -np.inf, -hard[0] - hard[1])
    best = np.zeros(count)
    for v in range(count - 1, -1, -1):
        best[v] = max(keep[v], drop[v], mixed[v])
        if v:
            p = tree.parent[v]
            keep[p] += keep[v]
            drop[p] += drop[v]
            mixed[p] += best[v]
    state = [0] * count  # 1 content, -1 boilerplate, 0 mixed
    for v in range(count):
        above = state[tree.parent[v]] if v else 0
        state[v] = above or (0 if best[v] == mixed[v] and tree.text[v] is None else 1 if keep[v] >= drop[v] else -1)
    return [v for v in range(count) if tree.text[v] and state[v] == 1]


class Extractor:
    """The two models: a node is all main text, a node has none."""

    def __init__(self, pages=400, seed=11):
        rows, content, boilerplate = [], [], []
        for html, marked in training_pages(pages, seed):
            tree = Tree(html)
            all_of, none_of = [True] * len(tree.tag), [True] * len(tree.tag)
            for v in range(len(tree.tag) - 1, -1, -1):
                if tree.text[v] is not None:
                    main = tree.text[v].startswith(marked) or marked in tree.text[v]
                    all_of[v], none_of[v] = main, not main
                if v:
                    p = tree.parent[v]
                    all_of[p] &= all_of[v]
                    none_of[p] &= none_of[v]
            rows.append(features(tree))
            content += all_of
            boilerplate += none_of
        x = np.concatenate(rows)
        self.content = Boosted().fit(x, np.array(content, float))
        self.boilerplate = Boosted().fit(x, np.array(boilerplate, float))

    def extract(self, pages):
        """The main text of every page."""
        trees = [Tree(html or "") for html in pages]
        x = np.concatenate([features(t) for t in trees]) if trees else np.zeros((0, 24 + len(TAGS)))
        content, boilerplate = self.content.margin(x), self.boilerplate.margin(x)
        out, start = [], 0
        for tree in trees:
            stop = start + len(tree.tag)
            out.append(" ".join(tree.text[v] for v in decode(tree, content[start:stop], boilerplate[start:stop])))
            start = stop
        return out


#: Invisible mark in the main text of training pages; features count it as one character.
MARK = "⁣"


def training_pages(count, seed):
    """Labelled pages in many layouts: (html, mark of main text). Labels of real pages do not exist, so layouts are drawn."""
    rng = random.Random(seed)
    syllables = [a + b for a in ["", "b", "c", "d", "f", "l", "m", "n", "r", "s", "t", "st", "ch"] for b in "aeiou"]

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def sentence(low=3, high=18):
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize() + rng.choice([".", ".", "!", "?", ""])

    def prose(sentences):
        return " ".join(sentence() for _ in range(rng.randint(1, sentences)))

    def attrs(*names):
        name = rng.choice(names)
        return rng.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {word()}"', f' class="{word()}-{name}"', ""])

    def links(low, high):
        return [f'<a href="/{word()}">{rng.choice([word(), sentence(2, 4)])}</a>' for _ in range(rng.randint(low, high))]

    def menu():
        items = links(2, 9)
        inner = "<ul>" + "".join(f"<li>{a}" + rng.choice(["</li>", "</li>", ""]) for a in items) + "</ul>"
        return rng.choice([f"<nav>{inner}</nav>", f'<div{attrs("menu", "nav", "navigation", "breadcrumb")}>{inner}</div>',
                           f'<nav{attrs("menu", "navbar")}>{" | ".join(items)}</nav>'])

    def advert():
        name = rng.choice(["ad", "ads", "advert", "banner", "promo", "sponsored"])
        return rng.choice(["", "<!-- ad -->"]) + f'<div class="{name}">{rng.choice([prose(3), sentence(), links(1, 1)[0]])}</div>'

    def notice():
        name = rng.choice(["cookie", "cookie-notice", "consent", "notice", "alert", "gdpr", "popup", "newsletter"])
        tag = rng.choice(["div", "section", "aside", "dialog"])
        return f'<{tag} {rng.choice(["class", "id"])}="{name}"><p>{prose(3)}</p>{rng.choice(["", "<button>" + word() + "</button>"])}</{tag}>'

    def form():
        return f'<form action="/s"><label>{word()}</label><input name="q"><button>{word()}</button><p>{rng.choice(["", sentence()])}</p></form>'

    def side():
        body = "".join(rng.choice([menu, advert, form, lambda: f"<h3>{sentence(1, 4)}</h3><p>{prose(3)}</p>"])() for _ in range(rng.randint(1, 3)))
        return rng.choice([f"<aside>{body}</aside>", f'<div class="{rng.choice(["sidebar", "widget", "side", "related"])}">{body}</div>'])

    def comments():
        name = rng.choice(["comments", "comment", "replies", "discussion", "respond"])
        inner = "".join(f'<{t}{attrs("comment", "reply")}><p>{prose(5)}</p></{t}>' for t in rng.choices(["div", "li", "article"], k=rng.randint(1, 6)))
        tag = rng.choice(["section", "div"])
        return f'<{tag} {rng.choice(["class", "id"])}="{name}"><h3>{sentence(1, 3)}</h3>{inner}</{tag}>'

    def top():
        return rng.choice([f"<header><h2>{word()}</h2>{rng.choice(['', menu()])}</header>",
                           f'<div{attrs("header", "masthead", "banner")}><a href="/">{word()}</a><p>{sentence(1, 6)}</p></div>', ""])

    def bottom():
        text = rng.choice(["&copy; ", "(c) ", ""]) + f"{word()}.example &middot; {prose(2)}"
        return rng.choice([f"<footer>{text}</footer>", f"<footer><p>{text}</p>{menu()}</footer>",
                           f'<div class="{rng.choice(["footer", "legal", "copyright"])}">{text}</div>'])

    def main():
        title = MARK + sentence(2, 10)
        parts = [f"<h1>{title}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14, 25])):
            text = MARK + rng.choice([prose(2), prose(6), prose(12), sentence(1, 3)])
            if rng.random() < 0.1:
                text += " " + links(1, 1)[0] + " " + sentence()
            parts.append(rng.choice([f"<p>{text}</p>"] * 8 + [
                f"<p>{text}", f"<p><b>{text}<br><p>{MARK + prose(3)}</p>", f"<h2>{text[:40]}</h2>", f"<blockquote>{text}</blockquote>",
                f"<div>{text}</div>", f"<ul><li>{text}</li><li>{MARK + sentence()}</li></ul>", f"<pre>{text}</pre>",
                f"<table><tr><td>{text}</td><td>{MARK + sentence(1, 4)}</td></tr></table>"]))
            if rng.random() < 0.08:
                parts.append(rng.choice([advert, side, notice])())
        inner = "".join(parts)
        return rng.choice([f"<article>{inner}</article>"] * 3 + [f"<main>{inner}</main>", f"<main><article>{inner}</article></main>",
                          f'<div class="{rng.choice(["content", "post", "entry-content", "story", "main"])}">{inner}</div>',
                          f'<section{attrs("content", "text", "article")}>{inner}</section>', f"<div>{inner}</div>"])

    for page in range(count):
        before = [piece() for piece in rng.choices([menu, advert, notice, form, side, top, top], k=rng.randint(0, 4))]
        after = [piece() for piece in rng.choices([comments, side, advert, menu, notice, form], k=rng.randint(0, 3))]
        body = "".join([*before, main(), *after, rng.choice([bottom, bottom, lambda: ""])()])
        html = (f"<!DOCTYPE html><html><head><title>{sentence()}</title><style>p{{margin:0}}</style>" + ("</head><body>", "</head><body>", "<body>", "")[page % 4]
                + rng.choice([body, f'<div id="page">{body}</div>', f'<div class="wrapper"><div>{body}</div></div>']) + "</body></html>")
        yield (html[:rng.randint(len(html) // 2, len(html))] if rng.random() < 0.1 else html), MARK


@lru_cache(maxsize=1)
def extractor():
    return Extractor()


def extract(pages):
    """Every row's page_id, url, text and n_chars: the main text of the whole html.

    A null or empty html, and one without main text, gives an empty text. References are decoded, white space inside a
    block becomes one space, blocks are joined by one space in page order. Broken markup is read as far as it
    goes. Null ids and repeated rows pass as they are; an empty table gives no rows; other columns are ignored.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    model = extractor()

    def run(batches):
        for batch in arrays.pieces(batches, "html"):
            yield arrays.record_batch(schema, batch.column("page_id"), batch.column("url"), model.extract(batch.column("html").to_pylist()))

    found = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
