"""What a tool's output is worth: a kind, and how much more or less of it to keep."""

from __future__ import annotations

from typing import NamedTuple

from ..functions import patterns as P
from ..functions.plain import any_match, parsed_or_none, pattern, trim
from .budget import NARROW
from .payload_json import embedded, is_api_response, is_search_result

_SEARCH, _INSTALL, _HELP, _URL = P.compiled(P.SEARCH), P.compiled(P.INSTALL), P.compiled(P.HELP), pattern(P.URL)


class Analysis(NamedTuple):
    subtype: str
    value: str
    multiplier: float


SEARCH_RESULTS = Analysis("search_results", "critical", 4.0)
API_RESPONSE = Analysis("api_response", "high", 4.0)
DATA_OUTPUT = Analysis("data_output", "high", 2.5)
INSTALL_LOG = Analysis("install_log", "low", 0.8)
USAGE_HELP = Analysis("usage_help", "low", 0.6)
ERROR_OUTPUT = Analysis("error_output", "medium", 1.2)
GENERIC = Analysis("generic", "medium", 1.0)
#: No kind keeps less than this share of the limit, so what is below it needs no analysis.
LEAST_MULTIPLIER = 0.6


def analyze(content: str) -> Analysis:
    """JSON first, then links, install logs, help texts and errors; only links are sought beyond the first 2,000 characters."""
    text = trim(content)
    start = text[:2000].lower()
    valid, value = parsed_or_none(text)
    if valid and (is_search_result(value) or is_api_response(value)):
        return SEARCH_RESULTS if is_search_result(value) else API_RESPONSE
    if any_match(_SEARCH, start) and is_search_result(embedded(text)):
        return SEARCH_RESULTS
    if len(_URL.findall(content)) >= 3:
        return DATA_OUTPUT
    for patterns, found in ((_INSTALL, INSTALL_LOG), (_HELP, USAGE_HELP)):
        if sum(bool(p.search(start)) for p in patterns) >= 2:
            return found
    return ERROR_OUTPUT if any_match(NARROW.errors, start) else GENERIC
