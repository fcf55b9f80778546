"""A main-content extractor: the part of a page that holds most running text, as Markdown.

A paragraph is worth the length of its text less twice that of the links inside, a list item half as much; the deepest block
element that holds most of the page's worth is taken. It is a function of (html, url), for parse_pages(..., extractor=main_text).
"""

from __future__ import annotations

from .extract import HEADINGS, LISTS, NOISE, REMOVED, Node, Tree, _drop, _inline

CONTAINERS = {"article", "main", "section", "div", "td", "body"}
#: Of the page's worth that an element must hold, and the least worth of a page that has main content.
SHARE, LEAST = 0.7, 80


def _worth(node: Node) -> int:
    total = 0
    for p in node.walk():
        if p.tag in ("p", "li", "blockquote", "pre"):
            links = sum(len(n.text()) for n in p.walk() if n.tag == "a")
            total += max(0, len(p.text(" ")) - 2 * links) // (2 if p.tag == "li" else 1)
    return total


def _markdown(top: Node) -> str:
    out = []
    for n in top.walk():
        if n.tag in HEADINGS:
            out.append(f"{'#' * int(n.tag[1])} {n.text(' ')}")
        elif n.tag in LISTS:
            out.append("\n".join(f"- {t}" for li in n.walk() if li.tag == "li" and (t := _inline(li))))
        elif n.tag == "table":
            rows = [[c.text(" ") for c in r.walk() if c.tag in ("td", "th")] for r in n.walk() if r.tag == "tr"]
            lines = [f"| {' | '.join(cells)} |" for cells in rows if cells]
            out.append("\n".join([*lines[:1], *([f"|{'|'.join(['---'] * len(rows[0]))}|"] if lines else []), *lines[1:]]))
        elif n.tag in ("p", "blockquote", "pre"):
            out.append(_inline(n))
    return "\n\n".join(x for x in out if x.strip())


def main_text(html: str, url: str) -> str | None:
    """None where no part of the page stands out, or what does holds too little."""
    tree = Tree()
    tree.feed(html)
    tree.close()
    top = tree.top
    _drop(top, lambda n: n.tag in REMOVED or any(NOISE.search(n.attrs.get(k, "")) for k in ("class", "id")))
    whole = _worth(top)
    if whole < LEAST:
        return None
    found = [n for n in top.walk() if n.tag in CONTAINERS and _worth(n) >= SHARE * whole]
    return _markdown(found[-1]) or None if found else None
