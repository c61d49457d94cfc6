"""Configuration trees with inheritance: a file names its parent under BASE, relative to its own folder."""

from __future__ import annotations

import json
import os


def read_file(path: str) -> dict:
    """JSON always; YAML if a YAML library is installed."""
    with open(path) as f:
        if path.endswith(".json"):
            return json.load(f)
        try:
            import yaml
        except ImportError as gone:
            raise RuntimeError("no YAML library is installed; use .json") from gone
        return yaml.safe_load(f)


def merged(base: dict, over: dict) -> dict:
    """Dictionaries merge by key at every depth; anything else, lists included, is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str) -> dict:
    """The file over its parent, and so on up to the root; a circle of parents is an error."""
    chain, seen = [], set()
    while path:
        path = os.path.abspath(path)
        if path in seen:
            raise ValueError(f"{path} is its own ancestor")
        seen.add(path)
        chain.append(read_file(path))
        parent = chain[-1].get("BASE")
        path = os.path.join(os.path.dirname(path), parent) if parent else ""
    out: dict = {}
    for tree in reversed(chain):
        out = merged(out, {k: v for k, v in tree.items() if k != "BASE"})
    return out
