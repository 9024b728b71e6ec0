"""Segmentation as loops over characters and lines: the brute-force form that the column form is held against."""

import re

from tessera.operators.segments import KEEP, STOP_WORDS

EDGE = " \t\n\v\f\r!,.:;?"
SPACE = " \t\n\v\f\r"
RULE = re.compile(r"([*+\-=_~])\1{2,}\Z")
TOKEN = r"(?:\d+|[IVXLCDM]{2,7}|[ivxlcdm]{2,7}|[A-Za-z])"
NUMBERED = re.compile(rf"\s*[(§]?\s*(?P<tokens>(?:{TOKEN}[.)\-/:](?!\s*[.)\-/:])\s*)+(?:{TOKEN})?)\s*[.):]?\s+")
COUNTED = re.compile(rf"{TOKEN}(?=[.)\-/:\s]|$)")


def protected(text: str) -> list[bool]:
    """Per character: it stands in something whose dots don't end a sentence."""
    mask = [False] * len(text)
    for pattern in KEEP:
        for m in pattern.finditer(text):
            if not any(mask[m.start() : m.end()]):
                mask[m.start() : m.end()] = [True] * (m.end() - m.start())
    return mask


def ordered_header(text: str) -> tuple[int, int] | None:
    """(level, offset of the title) of a numbered heading such as ``1.2 Title`` or ``A) Title``."""
    m = NUMBERED.match(text)
    if not m:
        return None
    tokens = COUNTED.findall(m["tokens"].strip(" .):"))
    return (len(tokens), m.end()) if tokens else None


def segment(text: str | None, headers: bool = False) -> list[dict]:
    """Sentences: cut at line ends and ! . ; ?, lines without a mark between them joined, rules dropped."""
    text = text or ""
    mask = protected(text)
    start, end = 0, len(text)
    while start < end and text[start] in EDGE and not mask[start]:
        start += 1
    while end > start and text[end - 1] in EDGE and not mask[end - 1]:
        end -= 1
    pieces, at = [], start
    for i in range(start, end + 1):
        if i == end or text[i] in "\n\v\f\r!.;?" and not mask[i]:
            a, b = at, i
            while a < b and text[a] in SPACE:
                a += 1
            while b > a and text[b - 1] in SPACE:
                b -= 1
            if a < b:
                pieces.append((a, b))
            at = i + 1
    out: list[dict] = []
    ruled = False
    for a, b in pieces:
        if RULE.match(text[a:b]):
            ruled = True
            continue
        row = {"start": a, "end": b, "blank_before": False, "rule_before": ruled, "newline": False, "level": 0, "title_offset": 0}
        if out and not ruled:
            gap = text[out[-1]["end"] : a]
            if gap.count("\n") < 2 and not gap.strip(SPACE):
                out[-1] |= {"end": b, "newline": True}
                continue
            row["blank_before"] = gap.count("\n") > 1
        ruled = False
        out.append(row)
    if headers:
        for i, row in enumerate(out):
            apart = i == 0 or row["blank_before"] or row["rule_before"]
            apart = apart and (i + 1 == len(out) or out[i + 1]["blank_before"] or out[i + 1]["rule_before"])
            if not apart or row["newline"]:
                continue
            own = text[row["start"] : row["end"]]
            marks = len(own) - len(own.lstrip("#"))
            body = own[marks:].lstrip()
            found = ordered_header(body if marks else own)
            if marks:
                row |= {"level": marks, "title_offset": len(own) - len(body) + (found[1] if found else 0)}
            elif found:
                row |= {"level": found[0], "title_offset": found[1]}
    return out


def sections_of(text: str | None) -> list[dict]:
    """Paragraphs under their headings: span, content, the heading trail (titles and depth), place among siblings."""
    text = text or ""
    trail: list[tuple[int, str, int]] = []
    out, siblings, fresh = [], 0, True
    for row in segment(text, headers=True):
        own = text[row["start"] : row["end"]]
        if row["level"]:
            trail = [t for t in trail if t[0] < row["level"]]
            trail.append((row["level"], own[row["title_offset"] :].strip(), row["start"]))
            siblings, fresh = 0, True
        elif fresh or row["blank_before"]:
            first = siblings == 0 and trail
            out.append({"range_start": trail[-1][2] if first else row["start"], "range_end": row["end"], "content": own, "titles": [t[1] for t in trail], "paragraph": siblings, "sentences": [own], "from": row["start"]})
            siblings, fresh = siblings + 1, False
        else:
            out[-1]["range_end"] = row["end"]
            out[-1]["sentences"].append(own)
            out[-1]["content"] = text[out[-1].setdefault("from", row["start"]) : row["end"]]
    return out


def tree_of(text: str | None) -> list[tuple]:
    """(node, parent, depth, level, title, start, end, paragraphs) of the heading tree; node 0 is the text itself, left out if one heading holds all."""
    text = text or ""
    nodes = [[0, None, 0, 0, None, 0, len(text), 0]]
    open_nodes = [0]
    for row in segment(text, headers=True):
        if not row["level"]:
            nodes[open_nodes[-1]][7] += 1
            continue
        while len(open_nodes) > 1 and nodes[open_nodes[-1]][3] >= row["level"]:
            nodes[open_nodes.pop()][6] = row["start"]
        title = text[row["start"] : row["end"]][row["title_offset"] :].strip()
        nodes.append([len(nodes), open_nodes[-1], len(open_nodes), row["level"], title, row["start"], len(text), 0])
        open_nodes.append(len(nodes) - 1)
    only = [n for n in nodes if n[1] == 0]
    if len(only) == 1 and not nodes[0][7]:
        nodes = [[n[0], n[1] or None, n[2] - 1, *n[3:]] for n in nodes[1:]]
    return [tuple(n) for n in nodes]


def subsegment(text: str, start: int, end: int) -> list[tuple[int, int, int]]:
    """(tier, start, end): clauses (: ;), phrases (quotes, brackets, commas), long words, pairs and triplets of them."""
    out = []
    for tier, cut in ((0, ":;"), (1, "\"(),:;[]")):
        parts = [(m.start() + start, m.end() + start) for m in re.finditer(f"[^{re.escape(cut)}]+", text[start:end])]
        trimmed = []
        for a, b in parts:
            while a < b and text[a] in SPACE:
                a += 1
            while b > a and text[b - 1] in SPACE:
                b -= 1
            if a < b:
                trimmed.append((a, b))
        if len(trimmed) > 1:
            out += [(tier, a, b) for a, b in trimmed]
    words = [(m.start() + start, m.end() + start) for m in re.finditer(r"\w[\w'’-]*", text[start:end])]
    words = [(a, b) for a, b in words if b - a > 4 and text[a:b].lower() not in STOP_WORDS]
    for tier, n in ((2, 1), (3, 2), (4, 3)):
        out += [(tier, words[i][0], words[i + n - 1][1]) for i in range(len(words) - n + 1)]
    return out
