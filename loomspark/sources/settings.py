"""Settings of a run: from a JSON or YAML file, or from command-line words."""

from __future__ import annotations

import json
from pathlib import Path


def scalar(text: str):
    """A plain value: JSON where it is JSON, else the text itself."""
    lowered = text.lower()
    if lowered in ("true", "false"):
        return lowered == "true"
    if lowered in ("null", "none", "~", ""):
        return None
    try:
        return json.loads(text)
    except ValueError:
        return text.strip("'\"")


def without_comment(line: str) -> str:
    """A line up to a mark of comment that stands outside of quotes."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i]
    return line


def yaml_value(text: str):
    """A value on one line: a scalar, or a list in brackets."""
    if text.startswith("[") and text.endswith("]"):
        inner = text[1:-1].strip()
        return [yaml_value(x.strip()) for x in inner.split(",")] if inner else []
    return scalar(text)


def read_yaml(text: str):
    """The subset of YAML that run settings use: nested keys and lists by indentation, scalars
    and bracketed lists."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in map(without_comment, text.splitlines()) if x.strip() and x.strip() != "---"]

    def block(at: int, indent: int):
        if at < len(lines) and lines[at][1].startswith("- ") or at < len(lines) and lines[at][1] == "-":
            out = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1][:1] == "-":
                rest = lines[at][1][1:].strip()
                if rest and ":" in rest and not rest.startswith(("'", '"', "[")) and (rest.endswith(":") or ": " in rest):
                    # A map inside a list goes on at the column of its first key.
                    deeper = indent + len(lines[at][1]) - len(lines[at][1][1:].lstrip())
                    lines[at] = (deeper, rest)
                    value, at = block(at, deeper)
                elif rest:
                    value, at = yaml_value(rest), at + 1
                else:
                    value, at = block(at + 1, lines[at + 1][0]) if at + 1 < len(lines) and lines[at + 1][0] > indent else (None, at + 1)
                out.append(value)
            return out, at
        out = {}
        while at < len(lines) and lines[at][0] == indent:
            key, _, rest = lines[at][1].partition(":")
            rest, at = rest.strip(), at + 1
            if rest:
                value = yaml_value(rest)
            elif at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("- "))):
                value, at = block(at, lines[at][0])
            else:
                value = None
            out[key.strip().strip("'\"")] = value
        return out, at

    return block(0, lines[0][0])[0] if lines else {}


def read_settings(source: str | list[str]) -> dict:
    """A file's settings, or those of words such as ``--cutoff_len 1024 --packing``."""
    if isinstance(source, str):
        text = Path(source).read_text(encoding="utf-8")
        return json.loads(text) if source.endswith(".json") else read_yaml(text)
    out, key = {}, None
    for word in source:
        if word.startswith("--"):
            key, _, value = word[2:].partition("=")
            out[key] = scalar(value) if value else True
        elif key:
            out[key] = scalar(word)
    return out
