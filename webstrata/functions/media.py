"""Stateful text parsers as table functions: DASH manifests and JSON assigned to a script variable."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from math import ceil, isfinite
from urllib.parse import urljoin

from pyspark.sql.functions import udtf

from .fixed import ISO_DURATION as _ISO

ISO_DURATION = re.compile(_ISO)
# what is never closed goes to the end, and values hold no "<", so no text is scanned twice
XML_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[?!][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z_][\w:.-]*+)(?P<rest>(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>""", re.S)
XML_ATTRIBUTE = re.compile(r"""([\w:.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
STRING_OR_BRACE = re.compile(r"""(?s)"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'|[{}"']""")

@dataclass
class Element:
    name: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Element] = field(default_factory=list)
    text: str = ""

    def all(self, name: str) -> list[Element]:
        return [c for c in self.children if c.name == name]

    def first(self, name: str) -> Element | None:
        return next((c for c in self.children if c.name == name), None)

    def number(self, name: str, default: float | None = None) -> float | None:
        """A finite attribute; what isn't a number counts as missing."""
        try:
            value = float(self.attributes[name])
        except (KeyError, ValueError):
            return default
        return value if isfinite(value) else default


def xml_tree(text: str) -> Element:
    """The elements of an XML text below a nameless root, in lower case and without prefixes. Ends that fit no open element are skipped, elements left open end with their parent."""
    root = Element("")
    stack, at = [root], 0
    for m in XML_TOKEN.finditer(text):
        stack[-1].text += unescape(text[at : m.start()])
        at, name = m.end(), (m["name"] or "").rpartition(":")[2].lower()
        if m["data"] is not None:
            stack[-1].text += m["data"]
        elif not name:
            continue
        elif m["end"]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            del stack[depth or len(stack) :]
        else:
            made = Element(name, {x[1].rpartition(":")[2].lower(): unescape(x[2] if x[2] is not None else x[3]) for x in XML_ATTRIBUTE.finditer(m["rest"])})
            stack[-1].children.append(made)
            if not m["rest"].endswith("/"):
                stack.append(made)
    return root


def _seconds(text: str | None) -> float | None:
    m = ISO_DURATION.match(text or "")
    return sum(float(v or 0) * k for v, k in zip(m.groups(), (86400, 3600, 60, 1), strict=True)) if m else None


def _fill(template: str, values: dict[str, object]) -> str:
    """A template's names stand between dollar signs, with a width where they end in %0Nd; two signs are one, names unknown here stay."""
    pieces = template.split("$")
    out = []
    for i, piece in enumerate(pieces):
        name, _, width = piece.partition("%0")
        if i % 2 == 0:
            out.append(piece)
        elif i == len(pieces) - 1:
            out.append("$" + piece)
        elif name in values and (not width or (width[-1:] == "d" and width[:-1].isdigit())):
            out.append(str(values[name]).rjust(int(width[:-1] or 0) if width else 0, "0"))
        else:
            out.append(f"${piece}$" if piece else "$")
    return "".join(out)


@dataclass(frozen=True)
class _Context:
    """What an element of a manifest hands down: its base, the attributes of templates with the nearest timeline, the nearest list, and the length of the period."""

    base: str
    template: Element | None = None
    listed: Element | None = None
    seconds: float | None = None

    def below(self, e: Element) -> _Context:
        base, template, listed = e.first("baseurl"), e.first("segmenttemplate"), e.first("segmentlist")
        if template and self.template:
            template = Element(template.name, self.template.attributes | template.attributes, template.children or self.template.children)
        seconds = _seconds(e.attributes.get("duration", e.attributes.get("mediapresentationduration")))
        return _Context(_joined(self.base, base.text.strip()) if base and base.text.strip() else self.base, template or self.template, listed or self.listed, self.seconds if seconds is None else seconds)


def _joined(base: str, url: str) -> str:
    try:
        return urljoin(base, url)
    except ValueError:
        return base


def _steps(context: _Context) -> Iterator[int]:
    """Begin of each segment of a template: by its timeline, else by equal lengths over the period."""
    t = context.template
    timeline, time = t.first("segmenttimeline"), 0
    if timeline is not None:
        for s in timeline.all("s"):
            length, time = int(s.number("d", 0)), int(s.number("t", time))
            for _ in range(max(0, int(s.number("r", 0))) + 1):
                yield time
                time += length
    else:
        length, scale = t.number("duration", 0), t.number("timescale", 1)
        if length > 0 and scale > 0 and context.seconds:
            for k in range(ceil(context.seconds * scale / length)):
                yield int(k * length)


def _representation(e: Element, own: _Context, outer: _Context) -> Iterator[str]:
    values = {"RepresentationID": e.attributes.get("id", ""), "Bandwidth": e.attributes.get("bandwidth", "")}
    if own.listed is not None:
        first = own.listed.first("initialization")
        yield from (_joined(own.base, x) for x in [first.attributes.get("sourceurl") if first else None, *[s.attributes.get("media") for s in own.listed.all("segmenturl")]] if x)
    elif own.template is not None:
        t = own.template
        if t.attributes.get("initialization"):
            yield _joined(own.base, _fill(t.attributes["initialization"], values))
        if t.attributes.get("media"):
            for k, time in enumerate(_steps(own)):
                yield _joined(own.base, _fill(t.attributes["media"], values | {"Number": int(t.number("startnumber", 1)) + k, "Time": time}))
    elif own.base != outer.base or e.first("baseurl"):
        yield own.base


def dash_segments(manifest: str, base: str, most: int = 200_000) -> Iterator[tuple[str, str]]:
    """(representation, URL): the different segment URLs of all representations, at most ``most`` of a manifest.

    Bases, templates and lists are handed down from the manifest over period and set to the representation; a template's attributes add to those above it. A period has its
    own length or the manifest's. A representation with nothing but a base is that one URL. Numbers that can't be read count as missing, and a length of 0 gives no segments.
    """
    seen: set[str] = set()
    for mpd in xml_tree(manifest).all("mpd"):
        top = _Context(base).below(mpd)
        for period in mpd.all("period") or [mpd]:
            inner = top.below(period) if period is not mpd else top
            for group in period.all("adaptationset"):
                outer = inner.below(group)
                for e in group.all("representation"):
                    for url in _representation(e, outer.below(e), outer):
                        if len(seen) >= most:
                            return
                        if url not in seen:
                            seen.add(url)
                            yield e.attributes.get("id", ""), url


@udtf(returnType="representation string, url string")
class DashSegments:
    """Segments of a manifest; use as a lateral join. A null or broken manifest gives no rows."""

    def eval(self, manifest: str, base: str):
        if manifest and base:
            yield from dash_segments(manifest, base)


def assigned_json(source: str, name: str) -> str | None:
    """The JSON object that a script assigns to a name: braces are balanced outside strings."""
    m = re.search(rf"(?:\b|[\"'\[]){re.escape(name)}[\"'\]]*\s*=\s*(?=\{{)", source)
    if not m:
        return None
    depth = 0
    for token in STRING_OR_BRACE.finditer(source, m.end()):
        if token[0] in ('"', "'"):  # a string that never ends
            return None
        if token[0] in "{}":
            depth += 1 if token[0] == "{" else -1
            if not depth:
                return source[m.end() : token.end()]
    return None


@udtf(returnType="json string")
class AssignedJson:
    """The object assigned to a name in a page's script, if there is one."""

    def eval(self, source: str, name: str):
        if source and name and (found := assigned_json(source, name)):
            yield (found,)
