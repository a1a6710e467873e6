"""An HTML tokenizer as a table function: tags with their attributes, and the text of raw elements.

Quoted values may hold ">" and "<", comments and raw elements (script, style, ...) hide what looks like tags inside them, and attributes may stand without quotes. What is never closed goes to the end of the text, which
is gone through once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql.functions import udtf

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)(?P<whole>>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)))?""")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}


def attributes_of(rest: str) -> dict[str, str]:
    """Attributes in lower case; of repeated ones the first counts, one without a value is empty."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(rest):
        out.setdefault(m[1].lower(), next((x for x in m.groups()[1:] if x is not None), ""))
    return out


def html_tokens(html: str) -> Iterator[tuple[str, str, dict[str, str] | None, str | None]]:
    """(kind, name, attributes, text): open and close tags, and the text of raw elements behind their open tag."""
    at = 0
    while m := TOKEN.search(html, at):
        at, name = m.end(), (m["name"] or "").lower()
        if not name or not m["whole"]:  # a tag that never ends is none
            continue
        if m["end"]:
            yield "close", name, None, None
            continue
        yield "open", name, attributes_of(m["rest"]), None
        if name in RAW:
            closed = re.compile(rf"(?i)</{name}(?=[\s/>])").search(html, at)
            stop = closed.start() if closed else len(html)
            yield "raw", name, None, html[at:stop]
            at = stop


@udtf(returnType="n int, kind string, name string, attributes map<string,string>, text string")
class HtmlTokens:
    """The tokens of a page in order; use as a lateral join. A null page has none."""

    def eval(self, html: str):
        for n, (kind, name, attributes, text) in enumerate(html_tokens(html or "")):
            yield n, kind, name, attributes, text
