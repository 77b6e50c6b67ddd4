"""Patterns of telling lines, as text that ``plain.pattern`` compiles."""

import re

from .plain import pattern

# Marks of errors, in the wider and the narrower set.
ERRORS_WIDE = (
    r"\b(error|err|fatal|panic|exception|traceback|stack\s*trace)\b",
    r"\b(fail(ed|ure|ing)?|assert(ion)?.*fail|expect(ed)?.*but\s+(got|received|was))\b",
    r"\b(oom|out\s+of\s+memory|killed|segfault|core\s+dump|abort(ed)?|crash(ed)?)\b",
    r"\b(syntax\s+error|compile\s+error|type\s+error|reference\s+error|undefined\s+(is\s+not|reference))\b",
    r"\b(exit\s+(code|status)\s*[^0]|exited?\s+with\s+[^0]|return(ed)?\s+non-?zero)\b",
    r"\b(warn(ing)?|deprecat(ed|ion))\b",
    r"\b(CrashLoopBackOff|ImagePullBackOff|ErrImagePull|OOMKilled|Evicted|BackOff)\b",
    r"\b([45]\d{2}\s+(error|forbidden|not\s+found|internal|bad\s+request|unauthorized|timeout))\b",
)
ERRORS_NARROW = (
    r"\b(error|err|fatal|panic|exception|traceback|stack\s*trace)\b",
    r"\b(fail(ed|ure|ing)?|assert(ion)?.*fail|expect(ed)?.*but\s+(got|received|was))\b",
    r"\b(oom|out\s+of\s+memory|killed|segfault|core\s+dump|abort(ed)?|crash(ed)?)\b",
    r"\b(syntax\s+error|compile\s+error|type\s+error|reference\s+error)\b",
    r"\b(exit\s+(code|status)\s*[^0]|exited?\s+with\s+[^0])\b",
    r"\b(CrashLoopBackOff|OOMKilled|ImagePullBackOff)\b",
)
# Lines that sum up a run; the fourth of the wider set is not in the narrower one.
SUMMARY_WIDE = (
    r"(?i)^\s*(Tests?|Specs?|Suites?|Total|Pass(ed)?|Fail(ed)?|Skip(ped)?|Error)\s*[:=]",
    r"(?i)^\s*\d+\s+(pass|fail|error|skip|pending)",
    r"^\s*(PASS|FAIL|OK|ERROR)\s",
    r"(?i)^(Tests?|Ran)\s+\d+\s+",
    r"^\s*✓|✗|✘|×|✔|❌|⚠",
    r"(?i)^\s*(BUILD|COMPILE|DEPLOY)\s+(SUCCESS|FAIL|ERROR)",
)
SUMMARY_NARROW = (
    r"(?i)^\s*(Tests?|Specs?|Suites?|Total|Pass(ed)?|Fail(ed)?|Error)\s*[:=]",
    r"(?i)^\s*\d+\s+(pass|fail|error|skip)",
    r"^\s*(PASS|FAIL|OK|ERROR)\s",
    r"^\s*✓|✗|✘|×|✔|❌|⚠",
    r"(?i)^\s*(BUILD|COMPILE|DEPLOY)\s+(SUCCESS|FAIL|ERROR)",
)
# Warnings that are no errors; lines whose templates would hide an outcome.
WARNING, GRAVE = r"\b(warn(ing)?|deprecat(ed|ion))\b", r"\b(error|fatal|fail)\b"
UNSAFE_FOR_TEMPLATES = r"\b(error|fatal|fail(ed|ure)?|panic|crash|exception)\b"
# Marks of search results, install logs and help texts.
SEARCH = (r"\bresults?\b.*\burl\b", r"\btitle\b.*\bsnippet\b", r"\bquery\b.*\bresults?\b", r"\bsearch_results?\b", r"\borganic_results?\b", r"\banswer\b.*\bresults?\b")
INSTALL = (
    r"\b(npm|yarn|pip|brew|apt|cargo)\s+(install|add|update)",
    r"\bdownloading\b.*\bpackage",
    r"\balready\s+satisfied",
    r"\bsuccessfully\s+installed",
    r"\bcollecting\b.*\bfrom",
    r"\b(added|removed|updated)\s+\d+\s+package",
    r"\bnpm\s+warn",
)
HELP = (r"(?m)^usage:\s", r"\b(--help|-h)\b.*\bshow\s+(this\s+)?help", r"\boptions?\s*:", r"\bcommands?\s*:", r"(?m)^\s{2,}(-\w|--\w)")
# What a text in small letters must hold, one of these, for each pattern to be met: a quick look before the slow one.
NEEDED = {
    ERRORS_NARROW: (
        ("err", "fatal", "panic", "exception", "traceback", "stack"),
        ("fail", "expect"),
        ("oom", "memory", "killed", "segfault", "core", "abort", "crash"),
        ("err",),
        ("exit",),
        ("crash", "oom", "image"),
    ),
    INSTALL: (("install", "add", "update"), ("downloading",), ("satisfied",), ("installed",), ("collecting",), ("package",), ("npm",)),
    HELP: (("usage:",), ("help",), ("option",), ("command",), ("-",)),
}
# Addresses.
URL = r"https?://[^\s)}\]\"']+"
# Lines of code, listings and fields.
IMPORT_LINE = r"^\s*(import|from|require|use|using|#include|package)\s"
DEFINITION_LINE = r"^\s*(export\s+)?(function|class|interface|type|const|let|var|def|fn|pub|struct|enum)\s"
LISTING_LINE = r"^\s*([-drwx]+\s+|total\s+|\d+\s+)"
FIELD_LINE = r"^(\s{0,4})(\w[\w\s-]{0,30})\s*[:=]\s*(.+)"


def compiled(texts: tuple[str, ...], flags: int = re.I) -> tuple[re.Pattern[str], ...]:
    """A leading (?i) or (?m) of a text becomes a flag; the others get ``flags``."""
    found = []
    for t in texts:
        own = {"(?i)": re.I, "(?m)": re.M | re.I}.get(t[:4])
        found.append(pattern(t[4:] if own else t, flags if own is None else own))
    return tuple(found)
