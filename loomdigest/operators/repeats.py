"""Repetition within one message: lines, blocks of lines, lines alike but for values, and records."""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict

from ..functions.patterns import FIELD_LINE
from ..functions.plain import cut, each_line, pattern, spread, tokens, trim, units
from ..functions.text import MASKS

_FIELD = pattern(FIELD_LINE)
_MASKS = [(pattern(p), m) for p, m in MASKS]


def lines_once(content: str) -> str | None:
    """Lines met over three times stay once, with a count."""
    lines = content.split("\n")
    keys = [trim(x) for x in lines]
    times = Counter(filter(None, keys))
    if len(lines) < 10 or max(times.values(), default=0) <= 3:
        return None
    out, met = [], set()
    for line, key in zip(lines, keys):
        if times[key] <= 3:
            out.append(line)
        elif key not in met:
            met.add(key)
            out += [line, f"  [↑ repeated {times[key]}× total, showing once]"]
    return "\n".join(out)


def blocks_once(content: str) -> str | None:
    """The commonest block of 3, 4, 5 or 2 lines, the first size with one met three times, stays once."""
    lines = content.split("\n")
    if len(lines) < 20:
        return None
    for size in (3, 4, 5, 2):
        blocks = [trim("\n".join(lines[i : i + size])) for i in range(len(lines))]
        times = Counter(b for b in blocks[: len(lines) - size + 1] if units(b) >= 20)
        top = max(times, key=times.__getitem__, default="")
        if times[top] < 3:
            continue
        out, at, shown = [], 0, False
        while at < len(lines):
            here = blocks[at] == top
            if not here:
                out.append(lines[at])
            elif not shown:
                out += [*lines[at : at + size], f"[↑ block repeated {times[top]}× total, showing once]"]
                shown = True
            at += size if here else 1
        return "\n".join(out)
    return None


def template(line: str) -> str:
    for p, mask in _MASKS:
        line = p.sub(mask, line)
    return line


def templates_sampled(content: str) -> str | None:
    """Of five or more lines alike but for values, the first, middle and last stay; only where such lines are a quarter of all."""
    lines = content.split("\n")
    if len(lines) < 20:
        return None
    groups: dict[str, list[int]] = defaultdict(list)
    for i, x in enumerate(map(trim, lines)):
        if units(x) >= 10 and (t := template(x)) != x:
            groups[t].append(i)
    groups = {t: at for t, at in groups.items() if len(at) >= 5}
    if not groups or sum(map(len, groups.values())) < len(lines) * 0.25:
        return None
    dropped, notes = set(), {}
    for t, at in groups.items():
        dropped |= set(at) - {at[i] for i in spread(len(at))}
        notes[at[0]] = f'  [↑ {len(at)} similar lines matching pattern "{cut(t, 80, 80)}", showing 3 samples]'
    return "\n".join("\n".join([x, notes[i]]) if i in notes else x for i, x in enumerate(lines) if i not in dropped)


def _field(line: str) -> tuple[str, str] | None:
    """A line's label and value."""
    m = _FIELD.match(line)
    return (m[2].strip().lower(), trim(m[3])) if m else None


def records_sampled(content: str, detailed: bool) -> str | None:
    """Of records of labelled lines, apart by blank lines, the first, middle and last stay, and what
    the fields hold is told. ``detailed`` names the fields, gives examples, and wants two labels a
    record and a gain of 15 %."""
    if content.count("\n") < 29:
        return None
    # a huge message is read a line at a time, twice: only counts, places and distinct values are kept
    times = Counter(f[0] for f in map(_field, each_line(content)) if f)
    known = {k for k, n in times.items() if n >= 5}
    if len(known) < 2:
        return None
    starts, ends, labels = array("q"), array("q"), 0
    values: dict[str, dict[str, None]] = defaultdict(dict)
    examples: dict[str, list[str]] = defaultdict(list)
    begin, first, held, before = 0, None, {}, None

    def end_record(last: int) -> None:
        nonlocal labels
        starts.append(first)
        ends.append(last)
        labels += len(held)
        for label, value in held.items():
            value = value if detailed else cut(value, 40, 37)
            values[label][value] = None
            if len(examples[label]) < 3:
                examples[label].append(value)

    for i, line in enumerate(each_line(content)):
        if not trim(line):
            if first is not None:
                end_record(i - 1)
            begin, first, held, before = i + 1, None, {}, None
            continue
        field = _field(line)
        if field and field[0] in known:
            # an unlabelled line before the first field belongs to its record
            first = i - (i > begin and before is None) if first is None else first
            held[field[0]] = field[1]
        before = field
    if first is not None:
        end_record(i)
    if len(starts) < 5 or (detailed and labels < 2 * len(starts)):
        return None
    told = [f"\n[↑ {len(starts)} records with similar structure, showing 3 samples]"]
    if detailed:
        told.append(f"[Record fields: {', '.join(k for k in times if k in known)}]")
    for label, distinct in values.items():
        if len(distinct) <= 5:
            told.append(f"  {label}: {', '.join(distinct)}")
        else:
            some = f", e.g.: {', '.join(cut(v, 40, 37) for v in examples[label])}" if detailed else ""
            told.append(f"  {label}: {len(distinct)} unique values{some}")
    shown = set(spread(len(starts)))
    out, r = [], 0
    for i, line in enumerate(each_line(content)):
        while r < len(starts) and ends[r] < i:
            r += 1
        if r == len(starts) or i < starts[r] or r in shown:
            out.append(line)
        if i == ends[0]:
            out += [*told, ""]
    text = "\n".join(out)
    return None if detailed and tokens(text) >= tokens(content) * 0.85 else text
