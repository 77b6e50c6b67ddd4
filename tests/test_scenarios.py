"""Whole messages of many professions, made from a seed, against the ceilings of what may be left of them.

The shapes and ceilings follow the blueprint's tables of scenarios; the contents are made here.
"""

import json
import random

import pytest

from loomdigest.config import Config
from loomdigest.functions.plain import tokens
from loomdigest.operators.dispatch import compact

R = random.Random(17)
NAMES = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper".split()


def pick(*options):
    return R.choice(options)


def number(low=0, high=1, digits=2):
    return f"{R.uniform(low, high):.{digits}f}"


def bibliography():
    one = "@article{{{a}{y}x{i},\n  author  = {{{A}, P and {B}, Q}},\n  title   = {{Notes on {a} growth in {b} soil}},\n  journal = {{Trees {y}}},\n  year    = {{{y}}},\n  volume  = {{{i}}},\n  pages   = {{{p}--{q}}},\n  doi     = {{10.5555/{y}.{i:04d}}},\n  abstract = {{We measure a growth of {g} percent over what was known on {n} plots.}},\n}}"
    rows = []
    for i in range(120):
        a, b = NAMES[i % 10], NAMES[(i * 3 + 1) % 10]
        rows.append(one.format(a=a, b=b, A=a.title(), B=b.title(), y=2015 + i % 9, i=i, p=i * 12 + 1, q=i * 12 + 9, g=number(70, 100, 1), n=i % 4 + 2))
    return "\n\n".join(rows)


def chunks():
    words = lambda n: " ".join(R.choice(NAMES) for _ in range(n))
    return json.dumps([{"chunk_id": i, "source": f"doc{i % 9}.md", "content": words(60), "metadata": {"score": R.random(), "tokens": 80, "tags": [pick(*NAMES)]}} for i in range(80)], indent=2)


def tree():
    rows = []
    for p in range(15):
        rows.append(f"├── packages/{NAMES[p % 10]}-{p}")
        rows += [f"│   ├── src/{k}{j}.ts" for k in ("index", "types", "utils", "handler") for j in range(6)]
    return "\n".join(rows)


def tables():
    return "\n\n".join(f"CREATE TABLE {NAMES[i % 10]}_{i} (\n  id BIGINT PRIMARY KEY,\n  name VARCHAR(255) NOT NULL,\n  status VARCHAR(20) DEFAULT 'new',\n  created_at TIMESTAMP DEFAULT now(),\n  updated_at TIMESTAMP\n);\nCREATE INDEX idx_{i} ON {NAMES[i % 10]}_{i} (status);" for i in range(50))


def crashes():
    rows = []
    for n in range(5):
        rows.append(f"2024-03-0{n + 1}T10:00:00Z INFO Starting application")
        rows += [f"2024-03-0{n + 1}T10:00:{i:02d}Z DEBUG Creating shared instance of bean '{NAMES[i % 10]}Service{i}'" for i in range(30)]
        rows += [f"2024-03-0{n + 1}T10:01:{i:02d}Z INFO Health check passed in {R.randint(2, 30)}ms" for i in range(15)]
        rows += ["WARN Memory usage at 91%", "ERROR java.lang.OutOfMemoryError: Java heap space", "ERROR   at a.b.Cache.put(Cache.java:10)", "FATAL Container killed: OOMKilled", "--- restart ---"]
    return "\n".join(rows)


def plan():
    return "\n".join(f'  # module.{NAMES[i % 10]}.instance[{i}] will be created\n  + resource "cloud_instance" "{NAMES[i % 10]}" {{\n      + id           = (known after apply)\n      + size         = "{pick("small", "large")}"\n      + zone         = "z{i % 3}"\n      + public_ip    = (known after apply)\n    }}\n' for i in range(200)) + "\nPlan: 200 to add, 0 to change, 0 to destroy."


def sql_rows():
    return json.dumps([{f"column_{c}": pick(None, R.randint(0, 999), f"v{R.randint(0, 99)}") for c in range(30)} for _ in range(200)])


def openapi():
    paths = {f"/v1/{NAMES[i % 10]}{i}": {m: {"summary": f"{m} {NAMES[i % 10]}", "parameters": [{"name": "id", "in": "path", "required": True, "schema": {"type": "string"}}], "responses": {"200": {"description": "ok"}, "404": {"description": "none"}}} for m in ("get", "post", "delete")} for i in range(20)}
    return json.dumps({"openapi": "3.0.0", "info": {"title": "Trees", "version": "1"}, "paths": paths, "components": {"schemas": {f"S{i}": {"type": "object"} for i in range(9)}}}, indent=2)


def found_lines():
    return "\n".join(f"src/{NAMES[f % 10]}/part{f}.ts:{R.randint(1, 400)}:  const value{i} = await load{NAMES[i % 10].title()}(context, {i});" for f in range(24) for i in range(6))


def metrics():
    rows = []
    for m in range(10):
        rows += [f'{NAMES[m]}_seconds_total{{node="n{n}",job="j"}} {number(0, 100)} {1700000000 + t * 15}' for n in range(8) for t in range(60)]
    return "\n".join(rows)


def translations():
    return json.dumps({lang: {f"page.{k}.title": f"{lang} text number {k} of the page" for k in range(28)} for lang in "en de fr es it nl pl pt sv da".split()}, indent=2)


def citations():
    return "Paper | " + " | ".join(f"P{i}" for i in range(40)) + "\n" + "\n".join(f"P{i} | " + " | ".join(pick("0", "1") for _ in range(40)) for i in range(60))


def lock_diff():
    rows = ["diff --git a/lock.yaml b/lock.yaml", "--- a/lock.yaml", "+++ b/lock.yaml"]
    for i in range(80):
        rows += [f"@@ -{i * 20},9 +{i * 20},9 @@"] + [f"   resolution: {NAMES[i % 10]}{j}" for j in range(14)] + [f"-  version: 1.{i}.0", f"+  version: 1.{i}.1"]
    return "\n".join(rows)


def bundle():
    return "\n".join(f"dist/assets/{NAMES[i % 10]}-{i:04x}.js   {number(1, 500)} kB │ gzip: {number(1, 90)} kB" for i in range(300))


def findings():
    return "\n\n".join(f"[{pick('HIGH', 'LOW', 'MEDIUM')}] Injection at src/{NAMES[i % 10]}.py:{i}\nRule: R{i % 12}\nDescription: Input reaches a query without checks\nCode: run(query + value{i})\nFix: Use parameters" for i in range(200))


def compiler():
    rows = [f"/Users/build/project/Sources/{NAMES[i % 10]}/View{i % 30}.swift:{i}:9: warning: initialization of immutable value 'x{i}' was never used; consider replacing it" for i in range(150)]
    return "\n".join([*rows, *[f"/src/Main.swift:{i}:1: error: cannot find type 'T{i}' in scope" for i in range(3)], "** BUILD FAILED **"])


def lineage():
    return "\n\n".join(f"Model: {NAMES[i % 10]}_{i}\nSchema: analytics\nMaterialization: {pick('table', 'view')}\nUpstream: a{i}, b{i}\nDownstream: c{i}\nColumns: {R.randint(3, 60)}\nTests: {R.randint(0, 9)} passed\nLast run: 2024-01-0{i % 9 + 1}" for i in range(50))


def playbook():
    rows = []
    for t in range(15):
        rows.append(f"\nTASK [{NAMES[t % 10]} : install part {t}] *********************")
        rows += [f"{pick('ok', 'changed')}: [host{h:02d}.example.com]" for h in range(30)]
    rows.append("\nPLAY RECAP ****")
    return "\n".join(rows + [f"host{h:02d}.example.com : ok=15 changed={h % 4} unreachable=0 failed=0" for h in range(30)])


def audit():
    return "\n\n".join(f"{NAMES[i % 10]}-lib{i}  <{i % 5}.2.0\nSeverity: {pick('high', 'moderate', 'low')}\nPrototype pollution - https://example.com/advisories/{i}\nDepends on: vulnerable versions of base{i}\nfix available via: update\nPaths: node_modules/lib{i}" for i in range(80))


def flake():
    return json.dumps({"nodes": {f"{NAMES[i % 10]}{i}": {"locked": {"lastModified": 1700000000 + i, "hash": f"sha256-{R.getrandbits(200):x}", "owner": "o", "repo": f"r{i}"}, "original": {"owner": "o", "repo": f"r{i}", "type": "git"}} for i in range(100)}, "root": "root", "version": 7}, indent=2)


def dashboard():
    return "Endpoint\t" + "\t".join(f"p{p}" for p in (50, 75, 90, 95, 99)) + "\terrors\tlimit\tused\tburst\n" + "\n".join(f"/api/{NAMES[i % 10]}/{i}\t" + "\t".join(str(R.randint(10_000, 900_000_000)) for _ in range(9)) for i in range(50))


def blame():
    return "\n".join(f"{R.getrandbits(32):08x} ({pick('Ann', 'Bob', 'Eve')}  2023-0{i % 9 + 1}-1{i % 9} 10:00:00 +0100 {i:4d})     return {NAMES[i % 10]}.value({i})" for i in range(300))


def notebook():
    return json.dumps({"cells": [{"cell_type": pick("code", "markdown"), "source": [f"line {j} of cell {i}\n" for j in range(8)], "outputs": [{"text": [f"out {j}\n" for j in range(9)]}]} for i in range(30)], "metadata": {"kernelspec": {"name": "py"}}}, indent=1)


def hits():
    return json.dumps({"took": 5, "hits": {"total": {"value": 50}, "hits": [{"_index": "logs", "_id": f"i{i}", "_score": R.random(), "_source": {"message": f"event {i} of {NAMES[i % 10]}", "level": "info", "host": f"h{i % 4}", "detail": "d" * 120}} for i in range(50)]}, "aggregations": {"levels": {"buckets": [{"key": "info", "doc_count": 50}]}}}, indent=2)


def requirements():
    return "\n".join(f"{NAMES[i % 10]}-part{i}=={i % 9}.{i % 7}.{i % 5} \\\n    --hash=sha256:{R.getrandbits(256):064x} \\\n    --hash=sha256:{R.getrandbits(256):064x}" for i in range(200))


def calls():
    return "\n".join(f'{1700000000 + i * 0.0013:.6f} read({R.randint(3, 40)}, "{R.getrandbits(40):x}"..., 4096) = {R.randint(1, 4096)} <0.0000{R.randint(10, 99)}>' for i in range(500))


def contract():
    clause = "The receiving party shall keep the information in confidence and shall not disclose it to any third party without prior written consent, except as the law requires."
    return "\n\n".join(f"## Section {s}\n" + "\n".join(f"{s}.{c} {clause}" for c in range(1, 9)) for s in range(1, 13))


def threads():
    rows = ["Incident Identifier: 1", "Exception Type:  EXC_BAD_ACCESS", "Triggered by Thread:  0"]
    for t in range(3):
        rows += ["", f"Thread {t}:"] + [f"{i}\tlib{NAMES[i % 10]}.dylib\t0x{R.getrandbits(40):x}\tsome_long_function_name_{i} + {i * 8}" for i in range(60)]
    return "\n".join([*rows, "", "Binary Images:", *[f"0x{R.getrandbits(36):x} - 0x{R.getrandbits(36):x} lib{i}.dylib" for i in range(20)]])


def license_file():
    return "/*\n" + " * Licensed under some terms; you may not use this file except in compliance with them.\n" * 100 + " */\nimport a\n\ndef main():\n    return a.run()\n"


SCENARIOS = {
    "bibliography": (bibliography, "file_content", 0.60),
    "chunks": (chunks, "tool_output", 0.85),
    "tree": (tree, "tool_output", 0.40),
    "tables": (tables, "file_content", 0.40),
    "crashes": (crashes, "tool_output", 0.30),
    "plan": (plan, "tool_output", 0.30),
    "sql_rows": (sql_rows, "tool_output", 0.15),
    "openapi": (openapi, "file_content", 0.50),
    "found_lines": (found_lines, "tool_output", 0.40),
    "metrics": (metrics, "tool_output", 0.15),
    "translations": (translations, "file_content", 0.50),
    "citations": (citations, "tool_output", 0.30),
    "lock_diff": (lock_diff, "patch", 0.30),
    "bundle": (bundle, "tool_output", 0.30),
    "findings": (findings, "tool_output", 0.30),
    "compiler": (compiler, "tool_output", 0.40),
    "lineage": (lineage, "tool_output", 0.30),
    "playbook": (playbook, "tool_output", 0.55),
    "audit": (audit, "tool_output", 0.30),
    "flake": (flake, "file_content", 0.40),
    "dashboard": (dashboard, "tool_output", 0.30),
    "blame": (blame, "tool_output", 0.30),
    "notebook": (notebook, "file_content", 0.50),
    "hits": (hits, "tool_output", 0.50),
    "requirements": (requirements, "file_content", 0.30),
    "calls": (calls, "tool_output", 0.30),
    "contract": (contract, "file_content", 0.60),
    "threads": (threads, "tool_output", 0.50),
    "license_file": (license_file, "file_content", 0.50),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_what_is_left_stays_below_the_ceiling(name):
    make, kind, ceiling = SCENARIOS[name]
    R.seed(name)
    text, failed = make(), []
    found = compact(text, kind, Config(), "rules", failed=failed)
    assert found is not None and failed == []
    assert found.tokens == tokens(found.content) < ceiling * tokens(text), (found.rule, found.tokens / tokens(text))
    if name == "crashes":
        assert "OutOfMemory" in found.content or "OOM" in found.content


@pytest.mark.parametrize("name", SCENARIOS)
def test_the_sync_profile_shrinks_them_too(name):
    make, kind, _ = SCENARIOS[name]
    R.seed(name)
    text, failed = make(), []
    found = compact(text, kind, Config(), "sync", failed=failed)
    assert failed == [] and (found is None or found.tokens < tokens(text))
