"""Block structure of Markdown: a scanner for the CommonMark blocks that carry prose, headings and fenced code.

Containers (quotes, list items) are peeled line by line and scanned again inside. Tables are paragraphs. Inline markup stays as
it is written. Simplified against the full specification: link reference definitions are recognised on one line only, and
a tab counts as the blanks up to the next multiple of four from the start of the container's line.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})(.*)$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_BREAK = re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_QUOTE = re.compile(r"^ {0,3}> ?")
_ITEM = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])( +(?=\S)|[ \t]*$)")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_DEFINITION = re.compile(r"""^ {0,3}\[[^\[\]]*[^\s\[\]][^\[\]]*\]:\s*\S+(?:\s+(?:"[^"]*"|'[^']*'|\([^()]*\)))?\s*$""")
_HTML_NAMES = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section "
    "summary table tbody td tfoot th thead title tr track ul"
).split()
#: How an HTML block starts and what its last line holds; a blank line ends it where that is None.
_HTML = [
    (re.compile(r"^ {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"^ {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r"^ {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r"^ {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"^ {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(r"^ {0,3}</?(?:" + "|".join(_HTML_NAMES) + r")(?:\s|/?>|$)", re.I), None),
]
_HTML_ALONE = re.compile(r"""^ {0,3}(?:<[A-Za-z][\w-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?)*\s*/?>|</[A-Za-z][\w-]*\s*>)\s*$""")
_FRONT_MATTER = re.compile(r"\A---\s*\n.*?\n---\s*\n", re.DOTALL)


@dataclass
class Block:
    kind: str  # heading, paragraph, fence, quote, list, item
    first: int = 0
    last: int = 0
    text: str = ""
    level: int = 0
    inner: list[Block] = field(default_factory=list)


def _indent(text: str) -> int:
    return len(text) - len(text.lstrip(" "))


def _html_start(text: str, in_paragraph: bool):
    for start, end in _HTML:
        if start.match(text):
            return (end,)
    return (None,) if not in_paragraph and _HTML_ALONE.match(text) else None


def _interrupts(text: str) -> bool:
    """Whether a line ends a paragraph that runs into it."""
    if _indent(text) >= 4:
        return False
    fence = _FENCE.match(text)
    if fence and not ("`" in fence[2] and "`" in fence[3]) or _ATX.match(text) or _BREAK.match(text) or _QUOTE.match(text):
        return True
    item = _ITEM.match(text)
    if item and text[item.end() :].strip() and (not item[2][0].isdigit() or item[2][:-1] == "1"):
        return True
    return _html_start(text, True) is not None


def _open_paragraph(lines: list[tuple[int, str]]) -> bool:
    """Whether the last block of these lines is a paragraph that a lazy line may continue."""
    blocks = scan(lines)
    while blocks and blocks[-1].kind in ("quote", "list", "item"):
        blocks = blocks[-1].inner
    return bool(blocks) and blocks[-1].kind == "paragraph" and bool(lines) and bool(lines[-1][1].strip())


def _take_quote(lines, at):
    inner = []
    while at < len(lines):
        number, text = lines[at]
        mark = _QUOTE.match(text)
        if mark:
            inner.append((number, text[mark.end() :]))
        elif not text.strip() or _interrupts(text) or not _open_paragraph(inner):
            break
        else:
            inner.append((number, text))
        at += 1
    return Block("quote", lines[0][0], inner[-1][0], inner=scan(inner)), at


def _take_list(lines, at):
    kind = None
    out = Block("list", lines[at][0])
    while at < len(lines):
        number, text = lines[at]
        mark = _ITEM.match(text)
        if not mark or _BREAK.match(text) or kind not in (None, mark[2][-1]):
            break
        kind = mark[2][-1]
        blanks = len(mark[3])
        empty = not text[mark.end() :].strip()
        body = mark.end(2) + (1 if empty or blanks > 4 else blanks)
        inner, at, gap = [(number, text[body:])], at + 1, False
        while at < len(lines):
            after, more = lines[at]
            if not more.strip():
                if empty and len(inner) == 1:
                    break  # an empty item takes no further paragraph
                inner.append((after, ""))
                gap = True
            elif _indent(more) >= body:
                inner.append((after, more[body:]))
                gap = False
            elif gap or _interrupts(more) or _ITEM.match(more) and _indent(more) < 4 or not _open_paragraph(inner):
                break
            else:
                inner.append((after, more))
            at += 1
        while len(inner) > 1 and not inner[-1][1].strip():
            inner.pop()
        out.inner.append(Block("item", number, inner[-1][0], inner=scan(inner)))
        while at < len(lines) and not lines[at][1].strip():
            at += 1
    out.last = out.inner[-1].last
    return out, at


def _take_fence(lines, at, fence):
    first, body, mark = lines[at][0], [], fence[2]
    close = re.compile(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
    at += 1
    last = first
    while at < len(lines):
        last, text = lines[at]
        at += 1
        if close.match(text):
            break
        body.append(text[min(_indent(text), len(fence[1])) :])
    return Block("fence", first, last, "".join(b + "\n" for b in body), inner=[Block("info", text=fence[3].strip())]), at


def scan(lines: list[tuple[int, str]]) -> list[Block]:
    """Blocks of the numbered lines of one container."""
    out, at = [], 0
    while at < len(lines):
        number, text = lines[at]
        if not text.strip():
            at += 1
            continue
        if _indent(text) >= 4:  # indented code
            while at < len(lines) and (_indent(lines[at][1]) >= 4 or not lines[at][1].strip()):
                at += 1
            continue
        fence = _FENCE.match(text)
        if fence and not ("`" in fence[2] and "`" in fence[3]):
            block, at = _take_fence(lines, at, fence)
            out.append(block)
            continue
        heading = _ATX.match(text)
        if heading:
            out.append(Block("heading", number, number, (heading[2] or "").strip(), len(heading[1])))
            at += 1
            continue
        if _BREAK.match(text):
            at += 1
            continue
        if _QUOTE.match(text):
            block, at = _take_quote(lines[at:], 0)[0], at + _take_quote(lines[at:], 0)[1]
            out.append(block)
            continue
        if _ITEM.match(text):
            block, at = _take_list(lines, at)
            out.append(block)
            continue
        html = _html_start(text, False)
        if html:
            while at < len(lines):
                ended = html[0].search(lines[at][1]) if html[0] else not lines[at][1].strip()
                at += 1
                if ended:
                    break
            continue
        if _DEFINITION.match(text):
            at += 1
            continue
        first = at
        at += 1
        level = 0
        while at < len(lines) and lines[at][1].strip():
            under = _SETEXT.match(lines[at][1])
            if under:
                level = 1 if under[1][0] == "=" else 2
                break
            if _interrupts(lines[at][1]):
                break
            at += 1
        text = "\n".join(t for _, t in lines[first:at]).strip()
        if level:
            out.append(Block("heading", lines[first][0], lines[at][0], text, level))
            at += 1
        else:
            out.append(Block("paragraph", lines[first][0], lines[at - 1][0], text))
    return out


def _texts_to_first_close(blocks: list[Block]):
    """Texts in an item up to the end of the first item within; the last value says whether that end was met."""
    for block in blocks:
        if block.kind in ("heading", "paragraph"):
            yield block.text
        elif block.kind == "quote":
            closed = yield from _texts_to_first_close(block.inner)
            if closed:
                return True
        elif block.kind == "list":
            yield from _texts_to_first_close(block.inner[0].inner)
            return True
    return False


def parse(content: str) -> dict:
    """Segments, headings and code blocks of a document; line numbers count the front matter, which has none of them.

    An item of a list gives its texts up to the first nested item's end, all at the item's first line; the nested item gives its
    own again. Paragraphs in lists are only that, headings in lists are both.
    """
    front = _FRONT_MATTER.match(content)
    offset = front.group().count("\n") if front else 0
    body = content[front.end() :] if front else content
    body = body.replace("\r\n", "\n").replace("\r", "\n")
    lines = [(i, t.expandtabs(4) if t[:1] in " \t" else t) for i, t in enumerate(body.split("\n"), 1 + offset)]
    if lines and not lines[-1][1]:
        lines.pop()
    segments, headings, code = [], [], []

    def walk(blocks, depth):
        for block in blocks:
            if block.kind == "heading":
                headings.append({"text": block.text, "level": block.level, "line_no": block.first})
                segments.append({"text": block.text, "line_start": block.first, "line_end": block.first, "segment_type": "heading"})
            elif block.kind == "paragraph" and not depth:
                segments.append({"text": block.text, "line_start": block.first, "line_end": block.last, "segment_type": "paragraph"})
            elif block.kind == "fence":
                code.append({"language": block.inner[0].text or None, "content": block.text, "line_no": block.first, "line_end": block.last})
            elif block.kind == "item":
                segments.extend({"text": t, "line_start": block.first, "line_end": block.last, "segment_type": "list_item"} for t in _texts_to_first_close(block.inner))
                walk(block.inner, depth + 1)
            elif block.kind in ("quote", "list"):
                walk(block.inner, depth)

    walk(scan(lines), 0)
    return {"segments": segments, "headings": headings, "code_blocks": code}
