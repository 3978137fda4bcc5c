"""Frontmatter values by path. YAML 1.2 core scalars: only true and false are booleans, dates stay text."""

from __future__ import annotations

import json
import re

import pyarrow as pa
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Loader(yaml.SafeLoader):
    pass


_Loader.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("int", r"^[-+]?(?:[0-9]+|0x[0-9a-fA-F]+|0o[0-7]+)$", "-+0123456789"),
    ("float", r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$|^[-+]?\.(?:inf|Inf|INF)$|^\.(?:nan|NaN|NAN)$", "-+0123456789."),
):
    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), list(_first))


#: Lines of a key and a plain scalar, in characters that have no meaning in YAML.
_PLAIN = re.compile(r"(?:[A-Za-z_][A-Za-z0-9_-]{0,99}: [A-Za-z0-9_](?:[A-Za-z0-9_./ -]*[A-Za-z0-9_./-])?(?:\n|\Z))+")


def load(block: str) -> object:
    if _PLAIN.fullmatch(block):
        pairs = [line.split(": ", 1) for line in block.removesuffix("\n").split("\n")]
        if not any(_typed(x) for pair in pairs for x in pair):
            return dict(pairs)
    return yaml.load(block, Loader=_Loader)


def _typed(text: str) -> bool:
    """Is a plain scalar something else than text?"""
    return any(pattern.match(text) for _, pattern in _Loader.yaml_implicit_resolvers.get(text[0], ()))


def block_text(content: str) -> str | None:
    """The lines between the frontmatter's delimiters; None without a closed block."""
    lines = content.removeprefix("﻿").split("\n")
    if not lines or lines[0].strip() != "---":
        return None
    for i in range(1, len(lines)):
        if lines[i].strip() == "---":
            return "\n".join(x.removesuffix("\r") for x in lines[1:i])
    return None


def _path(path: str) -> list[tuple[str, list[int]]]:
    """The keys of a dotted path, each with the indices after it."""
    out = []
    for part in path.split("."):
        key, bracket, rest = part.partition("[")
        rest = bracket + rest
        if not key:
            raise KeyError(f"malformed path segment in '{path}': empty key")
        indices = []
        while rest:
            if not rest.startswith("["):
                raise KeyError(f"malformed index in '{path}': expected '['")
            digits, close, after = rest[1:].partition("]")
            if not close:
                raise KeyError(f"malformed index in '{path}': unclosed '['")
            if not re.fullmatch(r"[0-9]+", digits) or int(digits) >= 1 << 64:
                raise KeyError(f"malformed index in '{path}': '[{digits}]' is not a number")
            indices.append(int(digits))
            rest = after
        out.append((key, indices))
    return out


def value_at(root: object, path: str) -> object:
    """The value at ``a.b[0].c``; KeyError with a message if there's none."""
    here = root
    for key, indices in _path(path):
        if not isinstance(here, dict):
            raise KeyError(f"'{path}': cannot read key '{key}' on a non-mapping value")
        if key not in here:
            raise KeyError(f"'{path}': key '{key}' not found")
        here = here[key]
        for i in indices:
            if not isinstance(here, list):
                raise KeyError(f"'{path}': cannot index '{key}[{i}]' into a non-sequence value")
            if i >= len(here):
                raise KeyError(f"'{path}': index {i} out of range for '{key}' (len {len(here)})")
            here = here[i]
    return here


class _Dumper(yaml.SafeDumper):
    yaml_implicit_resolvers = _Loader.yaml_implicit_resolvers


def to_text(value: object) -> str:
    """A scalar bare; a sequence or mapping as YAML in block style."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, dict)):
        return yaml.dump(value, Dumper=_Dumper, default_flow_style=False, sort_keys=False, allow_unicode=True, width=1 << 30).rstrip()
    return str(value)


def to_json(value: object) -> str:
    """JSON; a mapping with a key that isn't text is null."""

    def clean(v: object) -> object:
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items()} if all(isinstance(k, str) for k in v) else None
        if isinstance(v, list):
            return [clean(x) for x in v]
        return v if v is None or isinstance(v, (bool, int, float, str)) else str(v)

    return json.dumps(clean(value), ensure_ascii=False)


def display(value: object) -> str:
    """A value on one line: sequences and mappings joined by commas."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, list):
        return ", ".join(map(display, value))
    if isinstance(value, dict):
        return ", ".join(f"{display(k)}: {display(v)}" for k, v in value.items())
    return str(value)


def frontmatter_value(content: Column, path: str) -> Column:
    """The JSON of the value at ``path``; null without a closed block, with invalid YAML, or without the path."""
    return frontmatter_lookup(content, path)["value"]


def frontmatter_lookup(content: Column, path: str) -> Column:
    """value (JSON), text, and error, which says why there's no value; all null for a null content."""

    @F.arrow_udf("value string, text string, error string")
    def go(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            block = None if t is None else block_text(t)
            if block is None:
                rows.append((None, None, None if t is None else "no frontmatter block"))
                continue
            try:
                found = value_at(load(block), path)
                rows.append((to_json(found), to_text(found), None))
            except KeyError as e:
                rows.append((None, None, e.args[0]))
            except yaml.YAMLError as e:
                rows.append((None, None, f"frontmatter is not valid YAML: {' '.join(str(e).split())}"))
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names=["value", "text", "error"])

    return go(content)
