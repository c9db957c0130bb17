"""Review-record extraction from a table of raw pages (§2.2).

One ``mapInPandas`` pass parses every page once with the standard library's
HTML tokenizer and applies all rules; Spark partitions the pages, so the work
spreads over the cluster and a broken page yields an error row, never a failed
job. Rules are data (CSS-like selectors), not site-specific code.

Selectors support what the rules need: descendant chains of simple selectors
``tag``, ``.class`` (one or several, as in ``tag.a.b``) and
``tag[class^="prefix"]``. They are compiled once, on the driver, so a rule that
cannot be read fails the call and never turns pages into error rows. Trees are
walked with a stack of their own: nesting of any depth is fine.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract_between

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SKIP_TEXT = {"script", "style", "template"}
# An opening tag of these closes an open element of the same kind.
SELF_CLOSING_SIBLINGS = {"p", "li", "option", "tr", "td", "th"}


@dataclass
class Node:
    tag: str
    attrs: dict
    parent: "Node | None" = None
    children: list = field(default_factory=list)

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in SKIP_TEXT:
                todo.extend(reversed(n.children))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {})
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in SELF_CLOSING_SIBLINGS:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag == tag:
                    del self.stack[i:]
                    break
                if self.stack[i].tag in ("article", "div", "section", "ul", "ol", "table", "body"):
                    break
        node = Node(tag, {k: (v or "") for k, v in attrs}, self.stack[-1])
        self.stack[-1].children.append(node)
        if tag == "br":
            node.children.append("\n")
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack[-1].tag == tag:
            self.stack.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def parse_html(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


_SIMPLE = re.compile(r"""^(?P<tag>[a-zA-Z][\w-]*)?(?P<cls>(?:\.[\w-]+)*)"""
                     r"""(?:\[class\^=["'](?P<prefix>[^"']*)["']\])?$""")


def compile_selector(selector: str) -> list[tuple]:
    """[(tag, classes, class prefix), ...] of a descendant chain; ValueError when it cannot be read."""
    parts = []
    for tok in re.findall(r"(?:[^\s\[]|\[[^\]]*\])+", selector):
        m = _SIMPLE.match(tok)
        if not m:
            raise ValueError(f"unsupported selector: {tok}")
        tag = m.group("tag")
        parts.append((tag.lower() if tag else None, m.group("cls").split(".")[1:], m.group("prefix")))
    if not parts:
        raise ValueError(f"empty selector: {selector!r}")
    return parts


def _matches(node: Node, simple) -> bool:
    tag, classes, prefix = simple
    if tag and node.tag != tag:
        return False
    c = node.attrs.get("class", "")
    if classes and not set(classes) <= set(c.split()):
        return False
    return prefix is None or c.startswith(prefix)


def _walk(node: Node):
    todo = [iter(node.children)]
    while todo:
        for ch in todo[-1]:
            if isinstance(ch, Node):
                yield ch
                todo.append(iter(ch.children))
                break
        else:
            todo.pop()


def _selected(root: Node, selector):
    parts = compile_selector(selector) if isinstance(selector, str) else selector
    for n in _walk(root):
        if not _matches(n, parts[-1]):
            continue
        i, a = len(parts) - 2, n.parent
        while i >= 0 and a is not None and a is not root.parent:
            if _matches(a, parts[i]):
                i -= 1
            a = a.parent
        if i < 0:
            yield n


def select_all(root: Node, selector) -> list[Node]:
    """Matches in document order; ``selector`` is a string or a compiled one."""
    return list(_selected(root, selector))


def select_first(root: Node, selector) -> Node | None:
    return next(_selected(root, selector), None)


# Rules: the selectors each field is read from. Callers pass their own; these
# fit the generated test pages (title, article paragraphs/heading, nav list).
DEFAULT_RULES = {
    "title": "title",
    "review_container": "article",
    "paragraph": "p",
    "rating_container": "article",
    "rating_prefix": "div[class^='grade-{i}']",
    "date": "time",
    "product": "article h1",
    "group": "nav",
    "group_mark": "li",
    "city": "footer",
}

RATING_STEPS = 6          # rating_prefix is tried for i = 0, 1, ..
LARGEST = (1 << 63) - 1

RECORD_SCHEMA = ("page_id long, url string, title string, review string, grade long, grade_accepted boolean, "
                 "product string, clear_conditions int, polite_employee int, availability int, convenience int, "
                 "city string, date string, status string")
ERROR_RECORD = dict(title="", review="", grade=0, grade_accepted=False, product="", clear_conditions=0,
                    polite_employee=0, availability=0, convenience=0, city="", date=None)
GROUP_FIELDS = ("clear_conditions", "polite_employee", "availability", "convenience")


def compile_rules(rules: dict) -> dict:
    """Every rule as a compiled selector; ``rating_prefix`` as one per step. ValueError names the first bad one."""
    out = {k: compile_selector(v) for k, v in rules.items() if k != "rating_prefix"}
    out["rating_prefix"] = [compile_selector(rules["rating_prefix"].format(i=i)) for i in range(RATING_STEPS)]
    return out


def extract_record(html, rules: dict, fields=None) -> dict:
    """The ``fields`` (default: all) and the status of one page; any failure gives the error record. ``rules``: of
    ``compile_rules``, or plain ones. A rating beyond 64 bits is a failure of its page."""
    if not isinstance(rules["rating_prefix"], list):
        rules = compile_rules(rules)

    def wanted(*names):
        return fields is None or any(n in fields for n in names)

    def text_of(rule, default):
        n = select_first(root, rules[rule])
        return n.text().strip() if n is not None else default

    try:
        if not html:
            raise ValueError("No content")
        root, out = parse_html(html), {}
        if wanted("title"):
            out["title"] = text_of("title", "No title")
        if wanted("review"):
            box = select_first(root, rules["review_container"])
            out["review"] = "Review element not found" if box is None else "".join(
                p.text().strip() + " " for p in select_all(box, rules["paragraph"]))
        rating = select_first(root, rules["rating_container"])
        if rating is None:
            raise ValueError("no element matches " + _plain(rules["rating_container"]))
        out["grade"], out["grade_accepted"] = 0, False
        for i, step in enumerate(rules["rating_prefix"]):
            g = select_first(rating, step)
            txt = g.text().strip() if g is not None else ""
            if txt.isascii() and txt.isdigit():
                digits = txt.lstrip("0") or "0"
                if len(digits) > 19 or int(digits) > LARGEST:
                    raise ValueError(f"rating out of range: {digits[:40]}")
                out["grade"], out["grade_accepted"] = int(digits), i != 0
                break
        if wanted("date"):
            out["date"] = text_of("date", "0")
        if wanted("product"):
            out["product"] = text_of("product", "Unknown")
        if wanted(*GROUP_FIELDS):
            groups = select_all(root, rules["group"])
            for k, name in enumerate(GROUP_FIELDS):
                out[name] = len(select_all(groups[k], rules["group_mark"])) if k < len(groups) else 0
        if wanted("city"):
            out["city"] = text_of("city", "Unknown")
        return dict(out, status="good")
    except Exception as e:  # one bad page must not fail the job
        return dict(ERROR_RECORD, status=f"Error:{e}")


def _plain(selector: list[tuple]) -> str:
    return " ".join((tag or "") + "".join(f".{c}" for c in classes) + (f"[class^='{pre}']" if pre is not None else "")
                    for tag, classes, pre in selector)


def extract_pages(pages: DataFrame, rules: dict | None = None, title_start: str = "–",
                  title_end: str = "от", fields: Sequence[str] | None = None) -> DataFrame:
    """pages(page_id, url, html) → one raw review record per page.

    ``fields`` names the record columns to extract (default: all); rules of
    other columns are not run. ``bank`` is the title text between
    ``title_start`` and ``title_end``, computed natively after the Python pass.
    """
    r = compile_rules(dict(DEFAULT_RULES, **(rules or {})))
    known = [c.split()[0] for c in RECORD_SCHEMA.split(", ")][2:]
    names = [n for n in known if fields is None or n in fields or (n == "title" and "bank" in fields)
             or n == "status"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            recs = [extract_record(h, r, names) for h in b["html"]]
            out = pd.DataFrame.from_records(recs, columns=names)
            out.insert(0, "url", b["url"].values)
            out.insert(0, "page_id", b["page_id"].values)
            yield out

    schema = ", ".join(c for c in RECORD_SCHEMA.split(", ") if c.split()[0] in ("page_id", "url", *names))
    rec = pages.select("page_id", "url", "html").mapInPandas(run, schema)
    if fields is not None and "bank" not in fields:
        return rec
    bank = F.when(F.col("status") == "good", extract_between(F.col("title"), title_start, title_end)) \
            .otherwise(F.lit(""))
    return rec.withColumn("bank", bank)
