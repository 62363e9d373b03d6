"""Open elements of a page with the ends that its text leaves out: a list item ends with the next one, a paragraph with a block,
a cell with the next cell or row. Every tag costs the same, however many are open and whether its end has a beginning or not.
"""

from __future__ import annotations

from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Which open elements a beginning ends, and those within which they lie and which keep it from ending what is outside (the
#: rules of HTML's tree construction; fixed values).
_LISTS = "ul ol menu dl table td th caption section article aside nav header footer main blockquote form fieldset details figure button body html object template"
_TABLE = "table template html"
_PARAGRAPH = "applet button caption html marquee object table td template th"
ENDS = {
    "li": [("li", _LISTS)],
    "dt": [("dt dd", _LISTS)],
    "dd": [("dt dd", _LISTS)],
    "option": [("option", "select optgroup datalist")],
    "optgroup": [("option", "select datalist"), ("optgroup", "select datalist")],
    "tr": [("td th", _TABLE), ("tr", _TABLE), ("caption colgroup", _TABLE)],
    "td": [("td th", f"{_TABLE} tr")],
    "th": [("td th", f"{_TABLE} tr")],
    "tbody": [("td th", _TABLE), ("tr", _TABLE), ("tbody thead tfoot caption colgroup", _TABLE)],
}
ENDS |= {"thead": ENDS["tbody"], "tfoot": ENDS["tbody"]}
#: Blocks, which end a paragraph (fixed values).
BLOCKS = (
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main "
    "menu nav ol p pre search section summary table ul li dt dd"
)
for _tag in BLOCKS.split():
    ENDS[_tag] = [*ENDS.get(_tag, []), ("p", _PARAGRAPH)]
ENDS = {tag: [(names.split(), inside.split()) for names, inside in rules] for tag, rules in ENDS.items()}
#: An end doesn't reach beyond these, but for those of tables' own parts, which only a table stops (fixed values).
STOPS = frozenset("applet caption html marquee object table td template th".split())
PARTS = frozenset("table caption colgroup tbody thead tfoot tr td th".split())


class Scopes(HTMLParser):
    """Calls ``began`` for each element with its parents open, and ``ending`` before the open elements from a place on end."""

    def __init__(self):
        super().__init__()
        self.stack: list[str] = []
        self.places: dict[str, list[int]] = {}

    def began(self, tag: str, attrs: dict[str, str | None]) -> None:
        raise NotImplementedError

    def ending(self, at: int) -> None:
        raise NotImplementedError

    def _last(self, names) -> int:
        return max((p[-1] for n in names if (p := self.places.get(n))), default=-1)

    def _end(self, at: int) -> None:
        self.ending(at)
        for tag in reversed(self.stack[at:]):
            self.places[tag].pop()
        del self.stack[at:]

    def handle_starttag(self, tag, attrs):
        for names, inside in ENDS.get(tag, ()):
            at = self._last(names)
            if at > self._last(inside):
                self._end(at)
        given: dict[str, str | None] = {}
        for name, value in attrs:
            given.setdefault(name, value)  # of an attribute's repeats the first counts
        self.began(tag, given)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.stack))
            self.stack.append(tag)

    def handle_endtag(self, tag):
        at = self._last((tag,))
        stops = ("table", "template", "html") if tag in PARTS else STOPS
        if at >= 0 and at >= self._last(n for n in stops if n != tag):
            self._end(at)

    def read(self, html: str | None):
        self.feed(html or "")
        self.close()
        self._end(0)
        return self
