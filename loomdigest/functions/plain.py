"""The text measure and patterns for one message at a time, as ``text`` has them for columns."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator, Sequence

#: White space that trimming removes and ``\\s`` stands for.
BLANKS = "".join(map(chr, (*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
# Ranges of wide letters.
WIDE_RANGES = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0xF900, 0xFAFF), (0x2E80, 0x2EFF), (0x3000, 0x303F), (0x3040, 0x309F), (0x30A0, 0x30FF), (0xFF00, 0xFFEF), (0xAC00, 0xD7AF))
WIDE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in WIDE_RANGES) + "]")
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def spelled(text: str, blanks: str, ends: str, last: str, boundary: str = r"\b") -> str:
    """A pattern with its ``\\s``, ``.``, ``$`` and ``\\b`` spelt out, so that engines agree on them."""
    out, in_class, i = [], False, 0
    while i < len(text):
        two = text[i : i + 2]
        if two == r"\s":
            out.append(blanks if in_class else f"[{blanks}]")
        elif two == r"\b":
            out.append(boundary)
        elif two[0] == "\\":
            out.append(two)
        elif two[0] == "." and not in_class:
            out.append(f"[^{ends}]")
        elif two[0] == "$" and not in_class:
            out.append(last)
        else:
            in_class = two[0] == "[" or (in_class and two[0] != "]")
            out.append(two[0])
        i += 2 if two[0] == "\\" else 1
    return "".join(out)


def pattern(text: str, flags: int = 0) -> re.Pattern[str]:
    """A pattern with ASCII letters and digits, white space as in BLANKS, and ``.`` and ``$`` by line ends of any kind."""
    return re.compile(spelled(text, BLANKS, "\n\r\u2028\u2029", "$" if flags & re.M else r"\Z"), flags | re.A)


def units(x: str) -> int:
    """Length in UTF-16 units."""
    return len(x) if _below_256(x) else len(x) + len(_ASTRAL.findall(x))


def _below_256(x: str) -> bool:
    """Whether no character is wide or astral, told without a search."""
    if x.isascii():
        return True
    try:
        return x.encode("latin-1") is not None
    except UnicodeEncodeError:
        return False


def tokens(x: str) -> int:
    if _below_256(x):
        return -(-len(x) // 4)
    wide = len(WIDE.findall(x))
    return math.ceil(wide / 1.5 + (units(x) - wide) / 4)


def trim(x: str) -> str:
    return x.strip(BLANKS)


def nearest(x: float) -> int:
    """The nearest integer, halves up."""
    return math.floor(x + 0.5)


def each_line(x: str) -> Iterator[str]:
    """What ``x.split("\\n")`` has, one at a time."""
    at = 0
    while (end := x.find("\n", at)) >= 0:
        yield x[at:end]
        at = end + 1
    yield x[at:]


def cut(x: str, longest: int, keep: int, mark: str = "…") -> str:
    return x if units(x) <= longest else x[:keep] + mark


def fit(lines: Iterable[str], budget: float) -> tuple[int, int]:
    """How many leading lines stay within the budget, and their tokens."""
    count = spent = 0
    for line in lines:
        cost = tokens(line)
        if spent + cost > budget:
            break
        count, spent = count + 1, spent + cost
    return count, spent


def spread(n: int) -> list[int]:
    """Places of the first, middle and last of n items, each once."""
    return sorted({0, n // 2, n - 1}) if n else []


def any_match(patterns: Sequence[re.Pattern[str]], x: str) -> bool:
    return any(p.search(x) for p in patterns)


def _in_key_order(pairs: list[tuple[str, object]]) -> dict[str, object]:
    """Keys that are array indexes come first, ascending; a key met again keeps its first place."""
    found = dict(pairs)
    index = sorted((k for k in found if k.isascii() and k.isdigit() and str(int(k)) == k and int(k) < 2**32 - 1), key=int)
    return {k: found[k] for k in index} | found if index else found


def _number(x: str) -> float | int:
    value = float(x)
    return int(value) if math.isfinite(value) and value == int(value) and abs(value) < 1e21 else value


def _no_constant(x: str) -> None:
    raise ValueError(x)


def parse(x: str) -> object:
    """Strict JSON; ValueError otherwise."""
    try:
        return json.loads(x, object_pairs_hook=_in_key_order, parse_int=_number, parse_float=_number, parse_constant=_no_constant)
    except RecursionError as e:
        raise ValueError("nested too deep") from e


def parsed_or_none(x: str) -> tuple[bool, object]:
    """Whether the text, when it begins like an object or array, is JSON, and its value."""
    if x[:1] in ("{", "["):
        try:
            return True, parse(x)
        except ValueError:
            pass
    return False, None


def render(value: object, indent: int | None = None) -> str:
    return json.dumps(value, ensure_ascii=False, indent=indent, separators=(",", ": ") if indent else (",", ":"))


def kind(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"
