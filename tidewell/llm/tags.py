"""Where tags end and what attributes they have, in time proportional to the page's length."""

from __future__ import annotations

import re

_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)\s*+(?:=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?", re.S)


class TagEnds:
    """Ends of a page's tags: the first ``>`` outside quotes or, where quotes don't close before the page's end, the first one.

    A quote that was opened on the way to an unclosed one leads there from every other tag as well, so it is looked at once.
    """

    def __init__(self, html: str):
        self.html, self.dead = html, set()

    def after(self, start: int) -> int:
        """The place behind the end of the tag whose name ends at ``start``; -1 without any ``>``."""
        html, at, opened = self.html, start, []
        while (m := _STOP.search(html, at)) is not None:
            if m[0] == ">":
                return m.end()
            if m.start() in self.dead:
                break
            opened.append(m.start())
            at = html.find(m[0], m.end()) + 1
            if not at:
                break
        self.dead.update(opened)
        return html.find(">", start) + 1 or -1


def attributes(inside: str) -> dict[str, str]:
    """Attributes (lower-case names) and their values as written, the first of each name."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(inside):
        if value and value[0] in "\"'":
            value = value[1:-1]
        found.setdefault(name.lower(), value)
    return found
