"""Top-level nodes of wiki markup: headings, tags, links and the text between them."""

from __future__ import annotations

import html
import re

_CODE_TAGS = ("syntaxhighlight", "source", "code", "pre")
_HEADING = re.compile(r"^(={1,6})(.+?)\1[ \t]*$", re.M)
_OPEN_TAG = re.compile(r"<([A-Za-z][\w-]*)((?:\s[^<>]*?)?)(/?)>")
_EXTERNAL = re.compile(r"\[(?:https?|ftps?|irc|mailto|news):[^\]\n]*\]|(?:https?|ftps?)://[^\s<>\[\]{}|]+")
_ENTITY = re.compile(r"&(?:#\d+|#x[0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")
_LIST = re.compile(r"^[*#:;]+", re.M)
_RULE = re.compile(r"^-{4,}", re.M)
_QUOTES = re.compile(r"'{5}|'{3}|'{2}")
_START = re.compile(r"<!--|\{\{|\{\||\[\[|\[|<|&|''|https?://|ftps?://")


def _balanced(text: str, at: int, left: str, right: str) -> int:
    """The end of the construct that opens at ``at``, or -1."""
    depth, i = 0, at
    while i < len(text):
        if text.startswith(left, i):
            depth, i = depth + 1, i + len(left)
        elif text.startswith(right, i):
            depth, i = depth - 1, i + len(right)
            if not depth:
                return i
        else:
            i += 1
    return -1


def _construct(text: str, at: int):
    """(kind, end, parts) of the construct at ``at``, or None where it is plain text."""
    if text.startswith("<!--", at):
        end = text.find("-->", at)
        return ("comment", end + 3, None) if end >= 0 else None
    if text.startswith("{{", at):
        end = _balanced(text, at, "{{", "}}")
        return ("template", end, None) if end >= 0 else None
    if text.startswith("{|", at):
        end = _balanced(text, at, "{|", "|}")
        return ("tag", end, ("table", "", text[at + 2 : end - 2])) if end >= 0 else None
    if text.startswith("[[", at):
        end = _balanced(text, at, "[[", "]]")
        if end < 0 or "\n" in text[at : (at + 2 + len(text[at + 2 : end - 2].split("|")[0]))]:
            return None
        title, bar, label = text[at + 2 : end - 2].partition("|")
        return ("link", end, label if bar and label else title)
    external = _EXTERNAL.match(text, at)
    if external:
        return ("external", external.end(), None)
    entity = _ENTITY.match(text, at)
    if entity and html.unescape(entity[0]) != entity[0]:
        return ("entity", entity.end(), None)
    tag = _OPEN_TAG.match(text, at)
    if tag:
        name = tag[1].lower()
        if tag[3] or name in ("br", "hr", "wbr", "img"):
            return ("tag", tag.end(), (tag[1], tag[2], ""))
        close = re.compile(rf"</{re.escape(tag[1])}\s*>", re.I).search(text, tag.end())
        return ("tag", close.end(), (tag[1], tag[2], text[tag.end() : close.start()])) if close else None
    if text.startswith("''", at):
        mark = _QUOTES.match(text, at)[0]
        line_end = text.find("\n", at)
        close = text.find(mark, at + len(mark), line_end if line_end >= 0 else len(text))
        return ("tag", close + len(mark), ("i" if len(mark) == 2 else "b", "", text[at + len(mark) : close])) if close >= 0 else None
    return None


def nodes(text: str):
    """(kind, start, end, parts) of the top-level nodes in order."""
    marks = {m.start(): ("heading", m.end(), (len(m[1]), m[2])) for m in _HEADING.finditer(text)}
    marks |= {m.start(): ("list", m.end(), None) for p in (_LIST, _RULE) for m in p.finditer(text)}
    at = plain = 0
    while at < len(text):
        found = marks.get(at) or (_construct(text, at) if _START.match(text, at) else None)
        if not found:
            at += 1
            continue
        if plain < at:
            yield "text", plain, at, None
        yield found[0], at, found[1], found[2]
        at = plain = found[1]
    if plain < len(text):
        yield "text", plain, len(text), None


def stripped(text: str) -> str:
    """Text without its markup."""
    out = []
    for kind, start, end, parts in nodes(text):
        if kind == "text":
            out.append(text[start:end])
        elif kind == "link":
            out.append(stripped(parts))
        elif kind == "tag":
            out.append(stripped(parts[2]))
        elif kind == "heading":
            out.append(stripped(parts[1]))
        elif kind == "entity":
            out.append(html.unescape(text[start:end]))
        elif kind == "external" and text[start] == "[":
            out.append(" ".join(text[start + 1 : end - 1].split(" ")[1:]))
        elif kind == "external":
            out.append(text[start:end])
    return "".join(out)


def parse(content: str) -> dict:
    """Segments, headings and code blocks; a text's line is where it starts with its leading blanks.

    Templates, comments, external links and entities give nothing but part the prose around them.
    """
    segments, headings, code = [], [], []
    number, counted = 1, 0
    for kind, start, end, parts in nodes(content):
        number, counted = number + content.count("\n", counted, start), start
        last = number + content.count("\n", start, end)
        text = ""
        if kind == "heading":
            title = stripped(parts[1]).strip()
            headings.append({"text": title, "level": parts[0], "line_no": number})
            segments.append({"text": title, "line_start": number, "line_end": number, "segment_type": "heading"})
        elif kind == "tag" and parts[0] in _CODE_TAGS:
            language = re.search(r"""\blang\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'/>]+))""", parts[1])
            code.append({"language": next((g for g in language.groups() if g is not None), "") if language else None, "content": parts[2], "line_no": number, "line_end": last})
        elif kind == "tag":
            text = stripped(parts[2]).strip()
        elif kind == "text":
            text = content[start:end].strip()
        elif kind == "link":
            text, last = parts.strip(), number
        if text:
            segments.append({"text": text, "line_start": number, "line_end": last, "segment_type": "paragraph"})
    return {"segments": segments, "headings": headings, "code_blocks": code}
