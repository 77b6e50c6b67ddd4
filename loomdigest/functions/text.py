"""Text measures and classes as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config
from .plain import BLANKS, WIDE_RANGES, spelled

#: The ranges and blanks of ``plain``, spelt for columns and SQL; characters outside the basic plane.
CJK = "[" + "".join(rf"\x{{{a:04x}}}-\x{{{b:04x}}}" for a, b in WIDE_RANGES) + "]"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"
BLANK = "[" + "".join(rf"\x{{{ord(c):x}}}" for c in BLANKS) + "]"
_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
# Masks of changing parts of a line, in order.
MASKS = (
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "__UUID__"),
    (r"\b[0-9a-fA-F]{8,64}\b", "__HASH__"),
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}[.0-9Z]*", "__TIME__"),
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "__DATE__"),
    (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "__IP__"),
    (r"\b[0-9]+\.[0-9]+\b", "__NUM__"),
    (r"\b[0-9]{2,}\b", "__NUM__"),
    (r'"[^"]{1,80}"', '"__STR__"'),
    (r"\([^()]{4,60}\)", "(__ARGS__)"),
)


def utf16_length(x: Column) -> Column:
    return F.when(_ascii(x), F.length(x)).otherwise(F.length(x) + F.regexp_count(x, F.lit(ASTRAL)))


def _ascii(x: Column) -> Column:
    """Whether every character is a byte, so that none need be searched."""
    return F.octet_length(x) == F.length(x)


def estimate_tokens(x: Column) -> Column:
    """Tokens of a text: wide letters at 1.5 a token, other UTF-16 units at 4; null gives 0."""
    searched = once(F.regexp_count(x, F.lit(CJK)), lambda wide: F.ceil(wide / F.lit(1.5) + (F.length(x) + F.regexp_count(x, F.lit(ASTRAL)) - wide) / F.lit(4.0)))
    return F.coalesce(F.when(_ascii(x), F.ceil(F.length(x) / F.lit(4.0))).otherwise(searched), F.lit(0)).cast("long")


def trim(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def trimmed_start(x: Column, most: int) -> Column:
    """The first characters of the trimmed text; only these are looked at from the end, however long it is."""

    def start(left: Column) -> Column:
        head = F.substring(left, 1, most)
        goes_on = F.ltrim(F.substring(left, F.lit(most + 1), F.length(left)), F.lit(BLANKS)) != ""
        return F.when(goes_on, head).otherwise(F.rtrim(head, F.lit(BLANKS)))

    return once(F.ltrim(x, F.lit(BLANKS)), start)


def once(x: Column, make: Callable[[Column], Column]) -> Column:
    """``make(x)`` with x worked out a single time, however often it is used."""
    return F.get(F.transform(F.array(x), make), F.lit(0))


def apart(x: Column) -> Column:
    """x as a generated column: what is selected or filtered from it later does not work it out again."""
    return F.explode_outer(F.array(x))


def template(x: Column) -> Column:
    """A line with its changing parts masked."""
    for pattern, mask in MASKS:
        x = F.regexp_replace(x, pattern.replace(r"\b", _BOUNDARY), mask)
    return x


def category(content: Column, tool_name: Column | None = None) -> Column:
    """The class of a message; with a tool's name, that of its result."""
    patch = content.contains("@@") & content.contains("---") & content.contains("+++")
    plain = F.when(patch, "patch").otherwise("text")
    if tool_name is None:
        return plain
    name = F.lower(tool_name)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(name, w))
    by_tool = F.when(has(["edit", "patch", "replace", "diff", "apply"]), "patch").when(has(["read_file", "cat", "view_file"]) | name.isin("read", "file_content"), "file_content").otherwise("tool_output")
    return F.when(tool_name.isNull(), plain).otherwise(by_tool)


def threshold(kind: Column, config: Config) -> Column:
    """Tokens above which a class is compacted; null for classes never compacted."""
    scaled = lambda base: F.lit(int(base * config.multiplier + 0.5)).cast("long")
    return (
        F.when(kind == "tool_output", scaled(config.tool_output_max_tokens))
        .when(kind == "patch", scaled(config.patch_max_tokens))
        .when(kind == "file_content", scaled(config.file_content_max_tokens))
        .when(kind == "reasoning", scaled(config.tool_output_max_tokens * 1.5))
        .when(kind == "text", scaled(config.message_max_tokens))
    )


_ENDS = r"\n\r\x{2028}\x{2029}"


def for_spark(pattern: str) -> str:
    """A pattern of ``patterns`` for rlike and its kin."""
    return spelled(pattern, BLANK[1:-1], _ENDS, r"\z", _BOUNDARY)


def for_re2(pattern: str) -> str:
    """The same for engines with RE2, where word boundaries are ASCII ones."""
    return spelled(pattern, BLANK[1:-1], _ENDS, "$")


def either(patterns: tuple[str, ...], ignore_case: bool, spell=for_spark) -> str:
    """One pattern for any of several; their own leading (?i) holds for them alone."""
    return "|".join(f"(?{'i' if ignore_case or p.startswith('(?i)') else ''}:{spell(p.removeprefix('(?i)'))})" for p in patterns)
