"""The envelope of a long message: what it says, its sections by line range, and how to get it whole."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

from ..config import Config
from ..functions.plain import pattern, tokens, trim, units
from . import budget as B
from . import payload_json as J
from . import payload_text as T
from .analysis import analyze

_HEADING, _LABELLED = pattern(r"^(#{1,4})\s+(.+)"), pattern(r"^[-=]{3,}\s*(.+?)\s*[-=]{3,}$")
_RULE, _SEPARATOR = pattern(r"^---+$|^===+$"), pattern(r"^[-=]{3,}\s*.*\s*[-=]{3,}$")
_DIGITS = re.compile(r"[0-9]+")
# Names of variables worth telling, words that signal an outcome.
_VARIABLE, _TOLD_VARIABLE = pattern(r"^[A-Z_][A-Z0-9_]*="), pattern(r"^(PATH|HOME|PWD|USER|SHELL|LANG|NODE_ENV|DATABASE_URL|REDIS_URL|LOOMDIGEST_)")
_SIGNAL = pattern(r"(?:decided|confirmed|fixed|changed|updated|created|deleted|error|fail|success|result|conclusion|note|important|warning|assertion|exception|traceback|timeout|deprecated|vulnerab|compiled successfully|passing|failing|plan:|found \d+ errors?)", re.I)
_TITLE, _TITLE_MARK = pattern(r"^#{1,4}\s+"), pattern(r"^#+\s*")
# List items, column heads and places in code.
_BULLET, _BULLET_MARK = (pattern(r"^[-*]\s+"), pattern(r"^\d+[.)]\s+")), pattern(r"^[-*\d.)\s]+")
_COLUMNS = pattern(r"^[A-Z][A-Z0-9_./ -]{3,}(?:\s{2,}|\t)[A-Z][A-Z0-9_./ -]{2,}")
_PLACES = (pattern(r"^\S+\.\w+:\d+(?::\d+)?[: ]"), pattern(r'^File\s+".+",\s+line\s+\d+'), pattern(r"^(\./|/|[A-Za-z]:\\)"))


def _short(x: str, longest: int) -> str:
    return x if units(x) <= longest else x[: longest - 3] + "..."


def sections(content: str) -> list[tuple[int, int, str | None, str, int]]:
    """(first line, last line, heading, topic, characters); lines count from 1."""
    lines = content.split("\n")
    found: list[tuple[int, int, str | None, str, int]] = []
    start, heading, hints, size = 0, None, [], 0

    def close(end: int) -> None:
        if end > start:
            topic = heading or trim(" ".join([h for h in hints if len(h) > 20][:2])) or "(unlabeled section)"
            found.append((start + 1, end, heading, _short(topic, 120), size))

    for i, line in enumerate(lines):
        size += units(line) + 1
        room = i > start + 2
        title = _HEADING.match(line)
        label = _LABELLED.match(line) if room and not title else None
        if title or label or (room and _RULE.match(line)):
            close(i)
            start, heading, hints, size = i, trim(title[2] if title else label[1]) if title or label else None, [], 0
        elif len(hints) < 3 and len(trim(line)) > 10 and not line.startswith(("#", "```")):
            hints.append(trim(line))
    close(len(lines))
    return found


def _keypoint(line: str) -> tuple[str, str] | None:
    """What a trimmed line tells and the key under which alike ones count once."""
    if _TITLE.match(line):
        name = _TITLE_MARK.sub("", line, count=1)
        return (line, name) if len(name) > 2 else None
    if any(p.match(line) for p in _BULLET):
        name = _BULLET_MARK.sub("", line, count=1)
        return (line, name) if len(name) > 10 else None
    if _COLUMNS.match(line):
        return f"[table] {line}", f"table:{line}"
    if _VARIABLE.match(line) and _TOLD_VARIABLE.match(name := line.split("=")[0]):
        return line, f"env:{name}"
    if any(p.match(line) for p in _PLACES):
        return line, f"path:{_DIGITS.sub('#', line)}"
    marks = {d: line.count(d) for d in ",|\t"}
    if (marks[","] >= 3 or marks["|"] >= 3 or marks["\t"] >= 2) and max(marks.values()) >= 3 and not line[0] in "0123456789":
        return f"[fields] {line}", f"fields:{line}"
    return (line, line) if _SIGNAL.search(line) else None


def keypoints(content: str, most: int) -> str | None:
    """Telling lines, each once, up to ``most``; None below eight lines or three such."""
    lines = content.split("\n")
    found: dict[str, str] = {}
    for line in filter(None, map(trim, lines)) if len(lines) >= 8 else ():
        if len(found) >= most:
            break
        if point := _keypoint(line):
            found.setdefault(point[1][:120].lower(), _short(point[0], 220))
    return "\n".join(found.values()) if len(found) >= 3 else None


def samples(content: str) -> list[str]:
    """Lines at the quarters of those over five characters, alike ones once."""
    lines = [x for x in map(trim, content.split("\n")) if len(x) > 5 and not _SEPARATOR.match(x)]
    n, found = len(lines), {}
    for i in dict.fromkeys((0, n // 4, n // 2, n * 3 // 4, n - 1)) if n else ():
        found.setdefault(_DIGITS.sub("#", lines[i])[:140].lower(), _short(lines[i], 220))
    return list(found.values())


def _first(title: str, rows: list[str], shown: int, noun: str = "", extra: list[str] = []) -> str:
    more = [f"... and {len(rows) - shown} more {noun}"] if noun and len(rows) > shown else []
    return "\n".join([title, *rows[:shown], *extra, *more])


def _headed(first_line: str, title: str, noun: str) -> Callable[[list[str]], str | None]:
    start = pattern(first_line, re.I)
    return lambda rows: _first(title.format(len(rows) - 1), rows[1:], 5, noun) if len(rows) >= 4 and start.match(rows[0]) else None


def _variables(rows: list[str]) -> str | None:
    found = [x for x in map(trim, rows) if _VARIABLE.match(x)]
    told = [x for x in found if _TOLD_VARIABLE.match(x)] or found
    return _first(f"[Environment-like output: {len(found)} variables]", told, 8) if len(found) >= 5 else None


# The head of a list of pods.
_PODS = pattern(r"^NAME\s+READY\s+STATUS", re.I)


def _pods(rows: list[str]) -> str | None:
    if len(rows) < 4 or not _PODS.match(rows[0]):
        return None
    states = Counter((x.split() + ["unknown"] * 3)[2] for x in rows[1:])
    title = f"[Kubernetes pods: {len(rows) - 1} entries]\nStatuses: " + ", ".join(f"{s}({n})" for s, n in states.items())
    return _first(title, rows[1:], 5, "pods")


_SIZES = (pattern(r"^\S+\s+\.?/"), pattern(r"^\S+\s+\.$"))


def _folder_sizes(rows: list[str]) -> str | None:
    found = [x for x in map(trim, rows) if any(p.match(x) for p in _SIZES)]
    return _first(f"[Directory size listing: {len(found)} entries]", found, 6) if len(found) >= 5 else None


def _table(rows: list[str]) -> str | None:
    rows = list(map(trim, rows))
    d = next((d for d, least in ((",", 3), ("|", 3), ("\t", 2)) if rows and rows[0].count(d) >= least), None)
    names = [c for c in map(trim, rows[0].split(d)) if c] if d else []
    if len(rows) < 5 or len(names) < 4:
        return None
    return _first(f"[Tabular data: {len(rows) - 1} rows × {len(names)} columns]\nColumns: {', '.join(names[:10])}", rows[1:], 3, "row(s)")


# Lines of image builds and of plans.
_STEP, _BUILT = pattern(r"^Step\s+\d+/\d+\s*:"), pattern(r"compiled successfully|Successfully built|Successfully tagged|build complete", re.I)
_PLAN, _PLANNED = pattern(r"^Plan:\s+\d+\s+to add,\s+\d+\s+to change,\s+\d+\s+to destroy\.?$", re.I), pattern(r"^#\s+.+\s+will be\s+")


def _image_build(rows: list[str]) -> str | None:
    rows = list(map(trim, rows))
    steps = [x for x in rows if _STEP.match(x)]
    end = [f"Result: {x}" for x in rows if _BUILT.search(x)][:1]
    return _first(f"[Docker build log: {len(steps)} step(s)]", steps, 5, "step(s)", end) if len(steps) >= 3 else None


def _infrastructure_plan(rows: list[str]) -> str | None:
    rows = list(map(trim, rows))
    plan = next((x for x in rows if _PLAN.match(x)), None)
    return _first(f"[Terraform plan summary]\n{plan}", [x for x in rows if _PLANNED.match(x)], 5, "resource change(s)") if plan else None


# Lines of a repository's status.
_BRANCH, _CHANGES = pattern(r"On branch\s+", re.I), pattern(r"Changes not staged for commit|Untracked files", re.I)
_MODIFIED, _UNTRACKED = pattern(r"^modified:\s+"), pattern(r"^Untracked files:", re.I)
_HINT = pattern(r"^(use |no changes added|\(|On branch|Your branch)", re.I)


def _work_tree(rows: list[str]) -> str | None:
    rows = list(map(trim, rows))
    if not any(map(_BRANCH.search, rows)) or not any(map(_CHANGES.search, rows)):
        return None
    changed = [x for x in rows if _MODIFIED.match(x)]
    at = next((i for i, x in enumerate(rows) if _UNTRACKED.match(x)), len(rows))
    new = [x for x in rows[at + 1 :] if not _HINT.match(x)][:6]
    branch = [x for x in rows if _BRANCH.match(x)][:1]
    return "\n".join(["[git status summary]", *branch, f"Modified: {len(changed)}", f"Untracked: {len(new)}", *changed[:5], *new[:3]])


#: Summaries of known outputs, in the order tried; each takes the lines that are not blank.
KNOWN = {
    "environment": _variables,
    "pods": _pods,
    "images": _headed(r"^REPOSITORY\s+TAG\s+IMAGE ID", "[Docker images: {} entries]", "images"),
    "folder_sizes": _folder_sizes,
    "table": _table,
    "image_build": _image_build,
    "plan": _infrastructure_plan,
    "work_tree": _work_tree,
    "open_files": _headed(r"^COMMAND\s+PID\s+USER\s+FD", "[lsof output: {} descriptors]", "descriptor(s)"),
}


def _candidates(content: str, budget: int, most: int) -> Iterator[str | None]:
    yield keypoints(content, most)
    rows = [x for x in content.split("\n") if trim(x)]
    for summary in KNOWN.values():
        yield summary(rows)
    subtype = analyze(content).subtype
    if subtype in ("search_results", "api_response"):
        yield J.smart_summary(content, budget)
    elif subtype == "error_output":
        text = B.around_errors(content, budget, B.NARROW)
        yield text if text and tokens(text) < tokens(content) * 0.95 else None
    elif subtype == "data_output":
        from .dispatch import narrow_domain

        found = narrow_domain(content)
        yield found[1] if found else J.smart_summary(content, budget)


def envelope(content: str, role: str, config: Config = Config(), session_id: str | None = None, timestamp: str | None = None) -> str | None:
    """The envelope of a message above the limit of messages; None for others."""
    before = tokens(content)
    if before <= config.message_max_tokens:
        return None
    n_lines, chars = content.count("\n") + 1, units(content)
    room = max(200, int(config.message_max_tokens * 0.45 + 0.5))
    summary = None
    for text in _candidates(content, room, config.summary_max_lines):
        if text and trim(text):
            summary = B.truncate("\n".join(text.split("\n")[: config.summary_max_lines]), room)
            break
    out = [f"`[LAYERED RECALL] {role} message: {n_lines} lines, {chars:,} chars → ~{int(chars * 0.2 + 0.5):,} chars (__RATIO__% compression)`", ""]
    if summary:
        out += ["## Keypoint Summary", summary, ""]
    elif told := samples(content):
        out += ["## Representative Samples", *(f"- {x}" for x in told), ""]
    if parts := sections(content):
        out.append("## Section Index")
        for first, last, heading, topic, size in parts:
            hint = f"{size / 1000:.1f}K chars, large" if size > 5000 else f"{size / 1000:.1f}K chars" if size > 1000 else f"{size} chars"
            out.append(f"- L{first}-L{last}: {f'**{heading}** — ' if heading else ''}{topic} ({hint})")
        out.append("")
    out.append("## Full-text Access")
    out += [f"Session ID: `{session_id}`"] if session_id else []
    out += [f"Timestamp: {timestamp}"] if timestamp else []
    out.append(f"Original size: {n_lines} lines, {chars:,} chars")
    out += ["To retrieve the full original content, use `read_file` on the session transcript with the line ranges from the Section Index above.", ""]
    text = "\n".join(out)
    return text.replace("__RATIO__", f"{(1 - tokens(text) / before) * 100:.1f}", 1)
