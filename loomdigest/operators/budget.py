"""Cuts of one message to a budget of tokens: from the front, from both ends, or around its errors."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from ..functions import patterns as P
from ..functions.plain import any_match, fit, nearest, tokens, trim, units


def truncate(content: str, budget: int) -> str:
    """Leading whole lines within the budget; a first line above it is cut by its share."""
    if tokens(content) <= budget:
        return content
    lines = content.split("\n")
    n, _ = fit(lines, budget)
    kept = lines[:n] or [lines[0][: int(units(lines[0]) * (budget / tokens(lines[0])) * 0.9)] + "…"]
    rest = len(lines) - len(kept)
    return "\n".join(kept + ([f"\n[… truncated, {rest} more lines]"] if rest else []))


def _share(line: str, budget: int) -> int:
    """Characters of an overlong line that the budget pays for; 0 if too few to be of use."""
    n = int(units(line) * max(0.1, budget / tokens(line)) * 0.9)
    return n if n > 20 else 0


def head_tail(content: str, budget: int, partial: bool = False) -> str:
    """60 % of the budget for leading lines, the rest for trailing ones. ``partial`` also cuts
    into an end line too long to fit, and takes texts of up to three lines from the front."""
    lines = content.split("\n")
    if partial and len(lines) <= 3:
        return truncate(content, budget)
    for_head = nearest(budget * 0.6)
    for_tail = budget - for_head
    n, spent = fit(lines, for_head)
    head = lines[:n]
    if partial and not head and (size := _share(lines[0], for_head)):
        head = [lines[0][:size] + "…"]
    rest = lines[len(head) :]
    m, spent_below = fit(reversed(rest), for_tail)
    tail = rest[len(rest) - m :]
    if partial and not tail and rest and (size := _share(rest[-1], for_tail)):
        tail = ["…" + rest[-1][-size:]]
    gap = len(lines) - len(head) - len(tail)
    if gap <= 0:
        return content
    cost = "" if partial else f" ({tokens(content) - spent - spent_below} tokens)"
    return "\n".join([*head, f"\n[… {gap} lines omitted{cost} …]\n", *tail])


@dataclass(frozen=True)
class ErrorSet:
    errors: tuple
    summaries: tuple
    warnings_apart: bool
    follow: int


WIDE = ErrorSet(P.compiled(P.ERRORS_WIDE), P.compiled(P.SUMMARY_WIDE, 0), True, 2)
NARROW = ErrorSet(P.compiled(P.ERRORS_NARROW), P.compiled(P.SUMMARY_NARROW, 0), False, 1)
_WARNING, _GRAVE = P.compiled((P.WARNING, P.GRAVE))


def severity(line: str, by: ErrorSet) -> str | None:
    """summary, error, warning or None, for a trimmed line."""
    if not line or not any_match(by.summaries + by.errors, line):
        return None
    if any_match(by.summaries, line):
        return "summary"
    return "warning" if by.warnings_apart and _WARNING.search(line) and not _GRAVE.search(line) else "error"


def around_errors(content: str, budget: int, by: ErrorSet) -> str | None:
    """Both ends and, between them, the lines that tell of errors; None without such lines."""
    lines = content.split("\n")
    if not any(any_match(by.errors, x) for x in lines):
        return None
    classes = [severity(trim(x), by) for x in lines]
    found: dict[str, list[str]] = {"error": [], "summary": [], "warning": []}
    counts, met = dict.fromkeys(found, 0), set()
    for i, c in enumerate(classes):
        if c is None or (not by.warnings_apart and trim(lines[i]) in met):
            continue
        met.add(trim(lines[i]))
        counts[c] += 1
        found[c].append(lines[i])
        if c == "error":
            # what follows an error counts where only its first sight does
            below = [x for x in lines[i + 1 : i + 1 + by.follow] if trim(x).startswith("at ")]
            found[c] += below
            counts[c] += 0 if by.warnings_apart else len(below)
    if not found["error"] and not found["summary"]:
        return None
    told = list(chain(*found.values()))
    if by.warnings_apart:
        told = _first_of_each(told)
    for_errors, for_head = nearest(budget * 0.4), nearest(budget * 0.35)
    told = told[: fit(told, for_errors)[0]]
    head = lines[: fit(lines, for_head)[0]]
    rest = lines[len(head) :]
    m, _ = fit(reversed(rest), budget - for_errors - for_head)
    tail, gap = rest[len(rest) - m :], len(rest) - m
    if not by.warnings_apart:
        title = f"[⚠ Extracted {counts['error']} error(s), {counts['summary']} summary line(s):]"
        return "\n".join([*head, "", title, *told, "", f"[… {gap} lines omitted …]", *tail])
    middle = []
    if told and gap:
        title = f"[⚠ Extracted {counts['error']} error(s), {counts['warning']} warning(s), {counts['summary']} summary line(s) from {gap} omitted lines:]"
        middle = ["", title, *told, ""]
    if gap > len(told):
        middle.append(f"[… {gap - len(told)} other lines omitted …]")
    return "\n".join([*head, *middle, *tail])


def _first_of_each(lines: list[str]) -> list[str]:
    first: dict[str, str] = {}
    for x in lines:
        first.setdefault(trim(x), x)
    return list(first.values())
