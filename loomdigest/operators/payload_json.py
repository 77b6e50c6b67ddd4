"""Summaries of JSON texts: shape, common fields and a few samples."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from ..functions.plain import cut, fit, kind, parse, parsed_or_none, pattern, render, spread, tokens, trim, units

_PARAGRAPH = pattern(r"\n\s*\n")
# Names under which services give their results, texts and scores.
RESULT_KEYS = ("results", "organic_results", "search_results", "items", "entries", "data")
SUMMED_KEYS = ("results", "organic_results", "search_results", "items", "data")
BODY_KEYS = ("markdown", "text", "content", "body", "description")
TITLE_KEYS, URL_KEYS = ("title", "name"), ("url", "link", "href")
SNIPPET_KEYS = ("snippet", "content", "description", "text", "summary")


def compact(value: object, depth: int = 0) -> object:
    """A value with long texts cut, long lists shortened and deep parts counted."""
    if isinstance(value, str):
        return cut(value, 60, 50)
    if isinstance(value, (list, dict)) and depth > 1:
        return f"[{len(value)} items]" if isinstance(value, list) else f"{{{len(value)} keys}}"
    if isinstance(value, list):
        more = [f"… ({len(value) - 2} more)"] if len(value) > 2 else []
        return [compact(v, depth + 1) for v in value[:2]] + more
    if isinstance(value, dict):
        most = 3 if depth else 6
        short = {k: compact(value[k], depth + 1) for k in list(value)[:most]}
        return short | ({"…": f"{len(value) - most} more keys"} if len(value) > most else {})
    return value


def _objects(values: Iterable[object]) -> list[dict]:
    return [v for v in values if isinstance(v, dict)]


def key_counts(values: Iterable[dict]) -> Counter:
    """How many objects hold each key, keys in the order met."""
    return Counter(k for v in values for k in v)


def _common(objects: list[dict], least: float, ranked: bool = False) -> list[str]:
    counts = key_counts(objects)
    found = counts.most_common() if ranked else counts.items()
    return [k for k, n in found if n >= least]


def _kinds(values: Iterable[object]) -> str:
    return ", ".join(f"{k}: {n}" for k, n in Counter(map(kind, values)).items())


def _pretty(value: object, inset: str = "") -> str:
    return render(value, 2).replace("\n", "\n" + inset)


def _array(items: list) -> str:
    n, objects = len(items), _objects(items)
    if not n:
        return "[JSON Array: 0 items]"
    out = [f"[JSON Array: {n} items]"]
    if len(objects) > n * 0.8:
        counts = key_counts(objects).most_common()
        common, rare = [k for k, c in counts if c >= n * 0.5], [(k, c) for k, c in counts if c < n * 0.5]
        if common:
            out.append(f"Common fields ({len(common)}): {', '.join(common)}")
        if rare:
            more = f" … {len(rare) - 5} more" if len(rare) > 5 else ""
            out.append(f"Rare fields ({len(rare)}): " + ", ".join(f"{k}({c}/{n})" for k, c in rare[:5]) + more)
        at = list(range(n)) if n <= 3 else spread(n)
        out += [f"Samples (index {', '.join(map(str, at))}):", _pretty([compact(items[i]) for i in at])]
    else:
        out += [f"Item types: {_kinds(items)}", f"First {min(n, 2)} items:", _pretty([compact(v) for v in items[:2]])]
    return "\n".join(out + ([f"… and {n - 3} more items"] if n > 3 else []))


def _nested_array(held: dict, name: str) -> str:
    items, out = held[name], [f"[JSON Object: {len(held)} keys]"]
    out += [f'  "{k}": {render(compact(v) if isinstance(v, (list, dict)) else v)}' for k, v in held.items() if k != name]
    objects = _objects(items)
    common, at = _common(objects, len(objects) * 0.5), spread(len(items))
    out.append(f'\n  "{name}": [{len(items)} items]')
    if common:
        out.append(f"    Fields: {', '.join(common)}")
    out.append(f"    Samples (index {', '.join(map(str, at))}):")
    return "\n".join(out + [f"    {render(compact(items[i]))}" for i in at])


def _long_array(held: dict) -> str | None:
    """The first field with ten or more items, mostly objects."""
    return next((k for k, v in held.items() if isinstance(v, list) and len(v) >= 10 and len(_objects(v)) > len(v) * 0.5), None)


def _alike_children(held: dict) -> list[dict]:
    """The objects among the values, if five or more and over half; else nothing."""
    objects = _objects(held.values())
    return objects if len(objects) >= 5 and len(objects) > len(held) * 0.5 else []


def tool_summary(content: str) -> str | None:
    """Of a JSON array or a JSON object with over five keys; None for others."""
    valid, value = parsed_or_none(trim(content))
    if not valid:
        return None
    if isinstance(value, list):
        return _array(value)
    keys = list(value)
    if len(keys) <= 5:
        return None
    if children := _alike_children(value):
        out = [f"[JSON Object: {len(keys)} keys, {len(children)} object children]"]
        if common := _common(children, len(children) * 0.5, ranked=True):
            out.append(f"Child object fields: {', '.join(common)}")
        samples = [keys[i] for i in spread(len(keys))]
        out += [f"Value types: {_kinds(value.values())}", f"\nSample entries ({len(samples)} of {len(keys)}):"]
        out += [f'  "{k}": {render(compact(value[k]))}' for k in samples]
        plain = [k for k in keys if not isinstance(value[k], dict)]
        if 0 < len(plain) <= 10:
            out.append("\nScalar/array fields:")
            for k in plain[:8]:
                v = value[k]
                out.append(f'  "{k}": {v[:57] + "…" if isinstance(v, str) and units(v) > 60 else render(v)}')
            out += [f"  … and {len(plain) - 8} more"] if len(plain) > 8 else []
        return "\n".join(out)
    if (name := _long_array(value)) is not None:
        return _nested_array(value, name)
    preview = _pretty(compact(value))
    return f"[JSON Object: {len(keys)} keys]\n{preview}" if len(keys) > 10 else preview


def _shortened(value: object) -> object:
    if isinstance(value, str):
        return cut(value, 100, 80)
    if isinstance(value, list):
        return [_shortened(v) for v in (value if len(value) <= 5 else [*value[:3], f"… ({len(value) - 3} more)"])]
    return {k: _shortened(v) for k, v in value.items()} if isinstance(value, dict) else value


def config_summary(content: str, budget: int, detailed: bool) -> str | None:
    """Of a JSON file: alike items or children by samples, else the value with long parts cut if
    that is below the budget. ``detailed`` names common fields and compacts the samples."""
    valid, value = parsed_or_none(trim(content))
    if not valid:
        return None
    n = len(value)
    if isinstance(value, list) and n >= 10 and len(objects := _objects(value)) > n * 0.5:
        out = [f"[JSON Array: {n} items]"]
        if common := _common(objects, len(objects) * 0.5):
            out.append(f"Common fields: {', '.join(common)}")
        at = spread(n)
        out.append(f"Samples (index {', '.join(map(str, at))}):" if detailed else "Samples:")
        out += [_pretty(compact(value[i])) if detailed else "\n".join(_pretty(value[i]).split("\n")[:6]) for i in at]
        return "\n".join(out)
    if isinstance(value, dict) and n >= 10:
        if children := _alike_children(value):
            samples = [list(value)[i] for i in spread(n)]
            scalars = [f'  "{k}": {render(v)}' for k, v in value.items() if not isinstance(v, (list, dict))]
            out = [f"[JSON Object: {n} keys, {len(children)} object children]"]
            if detailed and (common := _common(children, len(children) * 0.5, ranked=True)):
                out.append(f"Child structure: {', '.join(common)}")
            out.append(f"{chr(10) if detailed else ''}Samples ({len(samples)} of {n}):")
            out += [f'  "{k}": {_pretty(compact(value[k]), "  ") if detailed else render(value[k])[:100]}' for k in samples]
            if 0 < len(scalars) <= (10 if detailed else 8):
                out += ["\nScalar fields:" if detailed else "Scalars:", *scalars]
            return "\n".join(out)
        if detailed and (name := _long_array(value)) is not None:
            return _nested_array(value, name)
        name = None if detailed else next((k for k, v in value.items() if isinstance(v, list) and len(v) >= 10), None)
        if name is not None:
            items = value[name]
            out = [f'[JSON Object: {n} keys, "{name}" has {len(items)} items]']
            out += [f'  "{k}": {render(v)[:80]}' for k, v in value.items() if k != name]
            return "\n".join([*out, f'  "{name}" samples:', *(f"    {render(items[i])[:120]}" for i in spread(len(items)))])
    short = _pretty(_shortened(value))
    return short if tokens(short) < budget else None


def is_search_result(value: object) -> bool:
    """Whether among the first three items, of the value or of its results, one has a link and a title."""
    if isinstance(value, list):
        names = [{k.lower() for k in v} for v in value[:3] if isinstance(v, dict)]
        return any(n & set(URL_KEYS) and n & set(TITLE_KEYS) for n in names)
    if not isinstance(value, dict):
        return False
    for key in RESULT_KEYS:
        if isinstance(value.get(key), list) and value[key]:
            return is_search_result(value[key])
    return isinstance(value.get("query"), str) and (isinstance(value.get("results"), list) or isinstance(value.get("answer"), str))


def is_api_response(value: object) -> bool:
    """Three or more entries, among them a container and a scalar."""
    values = list(value.values()) if isinstance(value, dict) else list(value) if isinstance(value, list) else []
    nested = sum(isinstance(v, (list, dict)) for v in values)
    return len(values) >= 3 and nested >= 1 and sum(v is not None for v in values) > nested


def embedded(content: str) -> object | None:
    """JSON that the text is, or that ends it and starts within its first 500 characters."""
    text = trim(content)
    starts = [i for i in (text.find("{"), text.find("[")) if 0 <= i < 500]
    try:
        return parse(text[min(starts) :]) if starts else None
    except ValueError:
        return None


def _said(value: object) -> str:
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return ",".join("" if v is None else _said(v) for v in value)
    return "[object Object]" if isinstance(value, dict) else render(value)


def _first(item: dict, keys: tuple[str, ...], longest: int) -> str:
    return _said(next((item[k] for k in keys if item.get(k) is not None), ""))[:longest]


def search_summary(value: object, budget: int) -> str:
    """The answer, then results by number with link, snippet and score, as far as the budget goes."""
    if isinstance(value, dict):
        items = next((value[k] for k in SUMMED_KEYS if isinstance(value.get(k), list)), [])
    else:
        items = value if isinstance(value, list) else []
    found: list[dict] = [v if isinstance(v, dict) else {} for v in items if isinstance(v, (dict, list))]
    if isinstance(value, dict) and isinstance(value.get("answer"), str):
        found.insert(0, {"_type": "answer", "content": value["answer"]})
    if not found:
        return "[Search results: 0 items]"
    blocks = [f"[Search results: {len(found)} items]"]
    for i, item in enumerate(found, 1):
        if item.get("_type") == "answer":
            blocks.append(f"\nAnswer: {_first(item, ('content',), 500)}")
            continue
        url, snippet = _first(item, URL_KEYS, 200), _first(item, SNIPPET_KEYS, 300)
        parts = [f"\n[{i}] {_first(item, TITLE_KEYS, 120)}"] + ([f"    URL: {url}"] if url else []) + ([f"    {snippet}"] if snippet else [])
        score = next((item[k] for k in ("score", "relevance_score") if item.get(k) is not None), item.get("rank"))
        if score is not None or "rank" in item:
            parts.append(f"    Score: {_said(score)}")
        blocks.append("\n".join(parts))
    n = 1 + fit(blocks[1:], budget - tokens(blocks[0]))[0]
    return "\n".join(blocks[:n] + ([f"\n… and {len(blocks) - n} more items (budget exceeded)"] if n < len(blocks) else []))


def _body(value: dict, content: str, budget: int) -> str | None:
    name = next((k for k in BODY_KEYS if isinstance(value.get(k), str) and units(value[k]) > 500), None)
    rest = {k: v for k, v in value.items() if k != name}
    if name is None or len(rest) < 2:
        return None
    about = []
    for k, v in rest.items():
        if kind(v) in ("number", "boolean") or (isinstance(v, str) and units(v) < 200):
            about.append(f"  {k}: {_said(v)}")
        elif isinstance(v, list) and len(v) <= 3 and all(isinstance(x, str) and units(x) < 100 for x in v):
            about.append(f"  {k}: {render(v)}")
    title = "[API Response — " + "\n".join(about) + "]" if about else "[API Response]"
    paragraphs = [p for p in _PARAGRAPH.split(value[name]) if trim(p)]
    n = max(min(1, len(paragraphs)), fit(paragraphs, max(200, budget - tokens(title)))[0])
    rest_note = [f"\n[… {len(paragraphs) - n} more paragraph(s) omitted …]"] if n < len(paragraphs) else []
    text = "\n".join([title, "", *paragraphs[:n], *rest_note])
    return text if tokens(text) < tokens(trim(content)) * 0.9 else None


def smart_summary(content: str, budget: int) -> str | None:
    """Of JSON, also where some text stands before it: results, items, the leading paragraphs of a
    body, or the value itself with what is over the budget cut."""
    value = embedded(content)
    if value is None:
        return None
    if is_search_result(value):
        return search_summary(value, budget)
    if isinstance(value, list):
        sample = value[:5]
        first = sample[0] if sample else None
        names = ", ".join(first if isinstance(first, dict) else map(str, range(len(first)))) if isinstance(first, (dict, list)) else "mixed"
        shown = _pretty(sample)
        out = [f"[JSON Array: {len(value)} items, fields: {names}]", f"Sample (first {len(sample)}):", cut(shown, budget * 4, budget * 4, "\n…")]
        return "\n".join(out + ([f"\n… and {len(value) - 5} more items"] if len(value) > 5 else []))
    if text := _body(value, content, budget):
        return text
    if len(value) > 10:
        sizes = {k: f"[Array: {len(v)} items]" if isinstance(v, list) else f"{{Object: {len(v)} keys}}" if isinstance(v, dict) else v for k, v in list(value.items())[:10]}
        return "\n".join([f"[JSON Object: {len(value)} keys]", _pretty(sizes), f"… and {len(value) - 10} more keys"])
    whole = _pretty(value)
    return whole if tokens(whole) <= budget * 1.2 else whole[: budget * 4] + "\n[… truncated]"
