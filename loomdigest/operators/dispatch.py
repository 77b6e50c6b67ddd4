"""Which operator compacts a message: strategies in order, the first that gains enough wins.

A strategy is a name, a function of the task that gives a text or None, and the share of the old
tokens that the text must stay below (None: any). The profile ``sync`` weighs tool outputs by their
kind first; the profile ``rules`` has the wider repetition and error rules and may ask a summarizer.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

from ..config import Config
from ..functions import patterns as P
from ..functions.plain import any_match, nearest, parsed_or_none, tokens, trim
from . import budget as B
from . import payload_json as J
from . import payload_text as T
from . import repeats as R
from .analysis import analyze

CONTEXT_LINES = {"aggressive": 1, "moderate": 2, "conservative": 3}
(_UNSAFE,) = P.compiled((P.UNSAFE_FOR_TEMPLATES,))
_TOOL_TASK = "Summarize this tool output. Keep findings, errors and warnings, values, file paths and identifiers; leave out repeated and boilerplate lines."
_FILE_TASK = "Summarize this file. Keep its purpose, key definitions and interfaces, configuration values and notable problems."


@dataclass(frozen=True)
class Task:
    content: str
    category: str
    before: int
    config: Config
    budget: int
    summarize: Callable[[str, str, int], str] | None = None


class Strategy(NamedTuple):
    name: str
    make: Callable[[Task], str | None]
    below: float | None = None


@dataclass(frozen=True)
class Rule:
    """A caller's own rule of the profile ``rules``: ``make(task)`` gives a text, or None to pass.

    Rules are asked by ascending priority, those of one priority in the order added and after
    the engine's own. It runs on executors, so it must be picklable.
    """

    name: str
    priority: int
    categories: tuple[str, ...]
    make: Callable[[Task], str | None]
    description: str = ""


class Result(NamedTuple):
    content: str
    tokens: int
    rule: str


def limit(category: str, config: Config) -> int | None:
    """Tokens above which a category is compacted."""
    base = {"tool_output": config.tool_output_max_tokens, "patch": config.patch_max_tokens, "file_content": config.file_content_max_tokens, "reasoning": config.tool_output_max_tokens * 1.5}.get(category)
    return None if base is None else nearest(base * config.multiplier)


def narrow_domain(content: str) -> tuple[str, str] | None:
    """Name and text of the first bibliography or table summary that gains enough."""
    task = Task(content, "tool_output", tokens(content), Config(), 0)
    found = _run(_NARROW_DOMAIN, task)
    return (found.rule, found.content) if found else None


def _asked(instruction: str, factor: float, share: float, header: str) -> Callable[[Task], str | None]:
    def make(t: Task) -> str | None:
        if t.summarize is None or t.before <= t.budget * factor:
            return None
        summary = t.summarize(t.content, instruction, nearest(t.budget * share))
        if not (isinstance(summary, str) and summary.strip()):
            raise ValueError("the summarizer gave no text")
        return header + summary

    return make


def _domain(t: Task) -> str | None:
    if T.looks_like_bibliography(trim(t.content)):
        return "bibtex"
    if T.delimiter(t.content, True) is not None:
        return "csv"
    return "markdown" if T.headings(t.content) >= 3 else None


def _repeats(t: Task) -> bool:
    return t.before > 200 and t.content.count("\n") >= 15 and not parsed_or_none(trim(t.content))[0]


def _only(when: Callable[[Task], bool], make: Callable[[Task], str | None]) -> Callable[[Task], str | None]:
    return lambda t: make(t) if when(t) else None


def _narrow_table(t: Task) -> str | None:
    d = T.delimiter(t.content, False)
    return None if d is None else T.table_summary(t.content, d, False)


def _wide_table(t: Task) -> str | None:
    d = T.delimiter(t.content, True)
    return None if d is None else T.table_summary(t.content, d, True)


def _diff(t: Task) -> str:
    return T.diff_summary(t.content, CONTEXT_LINES[t.config.aggressiveness], t.config.patch_max_tokens)


def _large_file(t: Task) -> bool:
    return t.before > t.config.file_content_max_tokens


_NARROW_DOMAIN = (
    Strategy("domain-aware/bibtex", _only(lambda t: T.looks_like_bibliography(t.content), lambda t: T.bibliography_summary(t.content, False)), 0.7),
    Strategy("domain-aware/csv", _narrow_table, 0.8),
)
_NARROW_REPEATS = (
    Strategy("repetition-elimination/records", _only(_repeats, lambda t: R.records_sampled(t.content, False)), 0.4),
    Strategy("repetition-elimination/lines", _only(_repeats, lambda t: R.lines_once(t.content)), 0.85),
)
_WIDE_DOMAIN = (
    Strategy("domain-aware/bibtex", _only(lambda t: _large_file(t) and _domain(t) == "bibtex", lambda t: T.bibliography_summary(t.content, True)), 0.7),
    Strategy("domain-aware/csv", _only(lambda t: _large_file(t) and _domain(t) == "csv", _wide_table), 0.8),
    Strategy("domain-aware/markdown", _only(lambda t: _large_file(t) and _domain(t) == "markdown", lambda t: T.document_skeleton(t.content, t.config.file_content_max_tokens)), 0.7),
)
_WIDE_REPEATS = (
    Strategy("repetition-elimination/records", _only(_repeats, lambda t: R.records_sampled(t.content, True)), 0.4),
    Strategy("repetition-elimination/lines", _only(_repeats, lambda t: R.lines_once(t.content)), 0.85),
    Strategy("repetition-elimination/blocks", _only(_repeats, lambda t: R.blocks_once(t.content)), 0.85),
    Strategy("repetition-elimination/templates", _only(lambda t: _repeats(t) and not _UNSAFE.search(t.content), lambda t: R.templates_sampled(t.content)), 0.25),
)
_LISTING = Strategy("tool-output-truncation/listing", lambda t: T.listing_summary(t.content))
_CODE = "file-content-distill/code-structure"
_CUT_FILE = Strategy("file-content-distill/truncate", lambda t: B.truncate(t.content, t.config.file_content_max_tokens))
_PATCH = Strategy("patch-distill", _diff)

#: By profile and category, in the order tried.
STRATEGIES: dict[str, dict[str, tuple[Strategy, ...]]] = {
    "sync": {
        "tool_output": (
            *_NARROW_DOMAIN,
            *_NARROW_REPEATS,
            Strategy("error-extraction", lambda t: B.around_errors(t.content, t.budget, B.NARROW), 0.95),
            Strategy("tool-output-truncation/json", lambda t: J.smart_summary(t.content, t.budget), 0.8),
            _LISTING,
            Strategy("tool-output-truncation/head-tail", lambda t: B.head_tail(t.content, t.budget, partial=True)),
        ),
        "patch": (*_NARROW_DOMAIN, *_NARROW_REPEATS, _PATCH),
        "file_content": (
            *_NARROW_DOMAIN,
            *_NARROW_REPEATS,
            Strategy("file-content-distill/config", lambda t: J.config_summary(t.content, t.config.file_content_max_tokens, False)),
            Strategy(_CODE, lambda t: T.code_skeleton(t.content, t.config.file_content_max_tokens, False), 0.7),
            _CUT_FILE,
        ),
    },
    "rules": {
        "tool_output": (
            *_WIDE_DOMAIN,
            *_WIDE_REPEATS,
            Strategy("error-extraction", _only(lambda t: t.before > t.config.tool_output_max_tokens, lambda t: B.around_errors(t.content, t.config.tool_output_max_tokens, B.WIDE)), 0.95),
            Strategy("tool-output-truncation/json", _only(lambda t: t.before > t.config.tool_output_max_tokens, lambda t: J.tool_summary(t.content)), 0.8),
            Strategy(_LISTING.name, _only(lambda t: t.before > t.config.tool_output_max_tokens, _LISTING.make)),
            Strategy("tool-output-truncation/llm", _asked(_TOOL_TASK, 2, 1.2, "[Distilled tool output]\n")),
            Strategy("tool-output-truncation/head-tail", _only(lambda t: t.before > t.config.tool_output_max_tokens, lambda t: B.head_tail(t.content, t.config.tool_output_max_tokens))),
        ),
        "patch": (Strategy(_PATCH.name, _only(lambda t: t.before > t.config.patch_max_tokens, _diff)),),
        "file_content": (
            *_WIDE_DOMAIN,
            *_WIDE_REPEATS,
            Strategy("file-content-distill/config", _only(_large_file, lambda t: J.config_summary(t.content, t.config.file_content_max_tokens, True))),
            Strategy(_CODE, _only(_large_file, lambda t: T.code_skeleton(t.content, t.config.file_content_max_tokens, True)), 0.7),
            Strategy("file-content-distill/llm", _asked(_FILE_TASK, 2.5, 1.1, "[Distilled file content]\n")),
            Strategy(_CUT_FILE.name, _only(_large_file, _CUT_FILE.make)),
        ),
        "reasoning": (),
        "text": _WIDE_REPEATS,
    },
}


#: Priorities of the engine's own rules, by how their names begin; others have the last.
PRIORITIES = (("domain-aware", 4), ("repetition-elimination", 5), ("error-extraction", 8), ("", 10))


def priority(name: str) -> int:
    return next(p for begin, p in PRIORITIES if name.startswith(begin))


def with_rules(strategies: tuple[Strategy, ...], own: tuple[Rule, ...], category: str) -> tuple[Strategy, ...]:
    """The engine's strategies and the caller's rules for a category, by priority."""
    ranked = [(priority(s.name), s) for s in strategies]
    ranked += [(r.priority, Strategy(r.name, r.make)) for r in own if category in r.categories]
    return tuple(s for _, s in sorted(ranked, key=lambda r: r[0]))


def _run(strategies: tuple[Strategy, ...], task: Task, failed: list[str] | None = None) -> Result | None:
    """The first strategy with a text that gains enough; one that raises is named in ``failed`` and passed over."""
    for s in strategies:
        try:
            text = s.make(task)
        except (ArithmeticError, ValueError, LookupError, TypeError, RuntimeError) as e:
            if failed is None:
                raise
            failed.append(f"{s.name}: {e}")
            continue
        if text is not None and (s.below is None or tokens(text) < task.before * s.below):
            return Result(text, tokens(text), s.name)
    return None


def _smart(subtype: str) -> Iterator[Strategy]:
    if subtype == "search_results":
        yield Strategy("smart/search-results", lambda t: J.smart_summary(t.content, t.budget), 1.0)
        yield Strategy("smart/search-fallback", lambda t: B.head_tail(t.content, t.budget, partial=True))
    elif subtype == "api_response":
        yield Strategy("smart/api-response", lambda t: J.smart_summary(t.content, t.budget), 1.0)


def compact(content: str, category: str, config: Config, profile: str = "sync", summarize: Callable[[str, str, int], str] | None = None, preserve: tuple[re.Pattern[str], ...] = (), failed: list[str] | None = None, own: tuple[Rule, ...] = ()) -> Result | None:
    """The compacted message, or None where it stays. Preserve patterns and the caller's own rules count in the profile ``rules`` only."""
    base = limit(category, config)
    if base is None or not config.enabled or (profile == "rules" and any_match(preserve, content)):
        return None
    strategies = STRATEGIES[profile].get(category, ())
    budget, before = base, tokens(content)
    if profile == "rules":
        budget = config.file_content_max_tokens if category == "file_content" else config.tool_output_max_tokens
        strategies = with_rules(strategies, own, category) if own else strategies
    elif category == "tool_output" and before > base * 0.6:
        found = analyze(content)
        base = budget = nearest(base * found.multiplier)
        strategies = (*_smart(found.subtype), *strategies)
    if before <= base:
        return None
    return _run(strategies, Task(content, category, before, config, budget, summarize), failed)
