"""Summaries of tables, bibliographies, headed documents, diffs, code and path listings."""

from __future__ import annotations

from collections import Counter
from decimal import ROUND_HALF_UP, Decimal
from itertools import groupby
from math import ceil, isfinite, isinf

from ..functions import patterns as P
from ..functions.plain import BLANKS, cut, fit, pattern, render, spread, tokens, trim, units

_NUMBER = pattern(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|Infinity)$")
_BASED = pattern(r"^0([xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)$")
_QUOTE_ENDS = pattern(r'^"|"$')
_ENTRY, _ENTRY_FIELD = pattern(r"^@(\w+)\s*\{(.+?)(?:,\s*)?$"), pattern(r'^(\w+)\s*=\s*[{"](.+?)[}"],?\s*$')
_ENTRY_START, _YEAR = pattern(r"@\w+\s*\{"), pattern(r"^\s*[+-]?\d+")
_HEADING = pattern(r"^#{1,4}\s")
_IMPORT, _DEFINITION, _LISTED = map(pattern, (P.IMPORT_LINE, P.DEFINITION_LINE, P.LISTING_LINE))
_SHOWN = pattern(r"^\s*(export|function|class)")
_EXTENSION = pattern(r"\.(\w+)$")


def number(x: str) -> float | None:
    """The number a cell holds; blank text is 0, other text None."""
    x = trim(x)
    if x[:1] == "0" and _BASED.match(x):
        return float(int(x, 0))
    return (float(x) if _NUMBER.match(x) else None) if x else 0.0


def _fixed(x: float) -> str:
    if isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    text = str(Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_UP))
    return text.replace("-", "") if x == 0 else text


def _short_number(x: float) -> str:
    if not isfinite(x):
        return "Infinity" if x > 0 else "-Infinity"
    return render(int(x) if x == int(x) and abs(x) < 1e21 else x)


def delimiter(content: str, strict: bool) -> str | None:
    """What cuts the first five lines into equally many columns, three or more. ``strict`` also wants
    column names to look like names, and knows semicolons."""
    lines = content.split("\n", 5)[:5]
    if strict and trim(lines[0]).startswith(("[", "{", "#", "//", "<!--")):
        return None
    for d in "\t,|;" if strict else "\t,|":
        widths = {len(x.split(d)) for x in lines}
        if len(widths) == 1 and max(widths) > 2:
            names = map(trim, lines[0].split(d))
            if not strict or all(units(n) < 80 and "(" not in n and "{" not in n for n in names):
                return d
    return None


def table_summary(content: str, d: str, detailed: bool) -> str | None:
    """Columns with ranges or distinct values, and the first, middle and last row; None below five
    filled lines. ``detailed``: ten columns, means and values; else eight."""
    quoted = '"' in content
    cells = [[_QUOTE_ENDS.sub("", trim(c)) if quoted else c.strip(BLANKS) for c in x.split(d)] for x in content.split("\n") if trim(x)]
    if len(cells) < 5:
        return None
    (names, *rows), most, longest = cells, 10 if detailed else 8, 30 if detailed else 25
    out = [f"[Tabular data: {len(rows)} rows × {len(names)} columns]", f"Columns: {', '.join(names)}"]
    for i, name in enumerate(names[:most]):
        values = [r[i] for r in rows if i < len(r) and r[i] != ""]
        # each distinct value is read once
        read = {v: number(v) for v in dict.fromkeys(values)}
        numbers = [n for n in map(read.__getitem__, values) if n is not None]
        distinct = list(read)
        if len(numbers) > len(values) * 0.8:
            low, high = min(numbers), max(numbers)
            out.append(f"  {name}: numeric, range [{_fixed(low)}, {_fixed(high)}], avg {_fixed(sum(numbers) / len(numbers))}" if detailed else f"  {name}: numeric [{_short_number(low)}, {_short_number(high)}]")
        elif not detailed:
            out.append(f"  {name}: {len(distinct)} unique values")
        elif len(distinct) <= 10:
            out.append(f"  {name}: categorical ({len(distinct)} unique): {', '.join(distinct[:5])}{'…' if len(distinct) > 5 else ''}")
        else:
            out.append(f"  {name}: text ({len(distinct)} unique), e.g.: {', '.join(cut(v, 30, 27) for v in values[:3])}")
    if detailed:
        out += [f"  … and {len(names) - most} more columns"] if len(names) > most else []
        out += ["", "Sample rows (first, middle, last):"]
    else:
        out.append("Sample rows:")
    return "\n".join(out + [f"  [{i}] {(d + ' ').join(cut(v, longest, longest - 3) for v in rows[i])}" for i in (0, len(rows) // 2, len(rows) - 1)])


def bibliography(content: str) -> list[tuple[str, str, dict[str, str]]]:
    """Type, key and one-line fields of each entry."""
    found, depth = [], 0
    for line in map(trim, content.split("\n")):
        if depth == 0:
            if start := _ENTRY.match(line):
                found.append((start[1].lower(), start[2], {}))
                depth = 1
            continue
        depth = max(0, depth + line.count("{") - line.count("}"))
        if depth and (field := _ENTRY_FIELD.match(line)):
            found[-1][2][field[1].lower()] = field[2]
    return found


def looks_like_bibliography(content: str) -> bool:
    return len(_ENTRY_START.findall(content)) >= 3


def bibliography_summary(content: str, detailed: bool) -> str | None:
    """Types, years and a line an entry; ``detailed`` adds venues and wants five entries, else three."""
    found = bibliography(content)
    if len(found) < (5 if detailed else 3):
        return None
    out = [f"[BibTeX: {len(found)} entries]", "Types: " + ", ".join(f"{t}({n})" for t, n in Counter(e[0] for e in found).items())]
    years = [y for e in found if (m := _YEAR.match(e[2].get("year", ""))) and (y := int(trim(m[0]))) > 1900]
    if years:
        out.append(f"Year range: {min(years)}–{max(years)}")
    if detailed:
        venues = Counter(cut(next((f[k] for k in ("journal", "booktitle", "publisher") if k in f), "unknown"), 40, 37) for _, _, f in found)
        out += ["Top venues: " + ", ".join(f"{v}({n})" for v, n in venues.most_common(5)), ""]
    out.append("Entries:")
    for _, key, f in found:
        author, year = f.get("author", "?"), f.get("year", "?")
        who = author.split(" and ")[0] + " et al." if units(author) > 30 else author
        out.append(f"- [{key}] {who} ({year}): {cut(f.get('title', '?'), 60, 57)}")
    return "\n".join(out)


def headings(content: str) -> int:
    return sum(bool(_HEADING.match(x + "\n")) for x in content.split("\n"))


def document_skeleton(content: str, budget: int) -> str | None:
    """Headings, and up to three lines of each section while within 80 % of the budget; the last
    section always, a section too long skipped. None below three headings or at 70 % or more."""
    lines = content.split("\n")
    sections: list[tuple[str | None, list[str]]] = [(None, [])]
    for x in lines:
        if _HEADING.match(x):
            sections.append((x, []))
        elif trim(x):
            sections[-1][1].append(x)
    if len(sections) < 4:
        return None
    out, spent = [f"[Document: {len(sections) - 1} sections, {len(lines)} lines]", ""], 0
    for i, (title, body) in enumerate(sections):
        if title is not None:
            out += ["", title]
            spent += tokens(title)
        last = i == len(sections) - 1
        start = "\n".join(body[:3])
        if body and (last or (title is not None and spent + tokens(start) < budget * 0.8)):
            spent += tokens(start)
            out += [start] + ([f"  [… {len(body) - 3} more lines in section]"] if len(body) > 3 else [])
    text = "\n".join(out)
    return text if tokens(text) < tokens(content) * 0.7 else None


def diff_stats(content: str) -> tuple[int, int, int, int]:
    """Files, added lines, deleted lines, hunks."""
    n = Counter("name" if x.startswith(("+++ ", "--- ")) else "@" if x.startswith("@@") else x[:1] if not x.startswith(("+++", "---")) else "" for x in content.split("\n"))
    return max(1, ceil(n["name"] / 2)), n["+"], n["-"], n["@"]


def _diff_part(x: str) -> str:
    if x.startswith(("diff ", "---", "+++")):
        return "file"
    return "hunk" if x.startswith("@@") else "change" if x.startswith(("+", "-")) else "context"


def diff_compressed(content: str, near: int) -> str:
    """A diff with ``near`` unchanged lines beside changes: after a change, chunks of 2 * near + 1
    shrink to their start and a note; what is left before a change or header keeps its end."""
    runs = [(part, list(g)) for part, g in groupby(content.split("\n"), key=_diff_part)]
    out, inside, changed = [], False, False
    for i, (part, lines) in enumerate(runs):
        if part in ("file", "hunk"):
            out += lines
            inside, changed = part == "hunk", False
        elif inside and part == "change":
            out += lines
            changed = True
        elif inside:
            chunk = 2 * near + 1
            while changed and len(lines) >= chunk:
                out += [*lines[:near], f"  [… {near + 1} unchanged lines …]"]
                lines = lines[chunk:]
            if i + 1 < len(runs):
                out += lines[-near:]
            else:
                out += lines[:near] + ([f"  [… {len(lines) - near} unchanged lines …]"] if len(lines) > near else [])
    return "\n".join(out)


def diff_summary(content: str, near: int, budget: int) -> str:
    text = diff_compressed(content, near)
    if tokens(text) <= budget * 1.5:
        return text
    files, added, deleted, hunks = diff_stats(content)
    return "\n".join([f"[Patch summary: {files} file(s), +{added}/-{deleted}, {hunks} hunk(s)]", *text.split("\n")[: ceil(budget / 3)], "[… diff truncated]"])


def code_skeleton(content: str, budget: int, counted: bool) -> str | None:
    """Up to 15 imports within 30 % of the budget, definitions within 80 %; None below three of both.
    ``counted``: the note on what is left out has its number."""
    lines = content.split("\n")
    imports, definitions = ([x for x in lines if p.match(x + "\n")] for p in (_IMPORT, _DEFINITION))
    if len(imports) + len(definitions) < 3:
        return None
    n, spent = fit(imports[:15], budget * 0.3)
    out = ["// Imports:", *imports[:n]] if imports else []
    out += [f"// … and {len(imports) - 15} more imports"] if len(imports) > 15 else []
    out += [""] if imports else []
    if definitions:
        m, _ = fit(definitions, budget * 0.8 - spent)
        out += ["// Definitions:", *(x.rstrip(BLANKS) for x in definitions[:m])]
        if m < len(definitions):
            left = f"{len(definitions) - sum(x.startswith('  ') or bool(_SHOWN.match(x)) for x in out)} more" if counted else "more"
            out.append(f"// … and {left} definitions")
    return "\n".join([*out, "", f"// [File: {len(lines)} lines total, structural summary above]"])


def listing_summary(content: str) -> str | None:
    """Files, directories and commonest extensions of 20 or more lines, 60 % of them like paths."""
    lines = [x for x in content.split("\n") if trim(x)]
    if len(lines) < 20 or sum("/" in x or "\\" in x or bool(_LISTED.match(x)) for x in lines) / len(lines) < 0.6:
        return None
    paths = [x for x in map(trim, lines) if "/" in x]
    folders = {x.rpartition("/")[0] for x in paths}
    endings = Counter(m[1] for x in paths if (m := _EXTENSION.search(x)))
    top = "\n".join(f"  .{e}: {n}" for e, n in endings.most_common(8))
    return "\n".join([f"[File listing: {len(paths)} files in {len(folders)} directories]", f"Top extensions:\n{top}", "Sample paths:", *lines[:5], f"… and {len(lines) - 5} more entries"])
