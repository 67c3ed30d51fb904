"""A tree's own settings: ``.cairn/config.json`` and its rules of what to leave out."""

from __future__ import annotations

import json
import os

FILE = os.path.join(".cairn", "config.json")


def read_config(root: str) -> dict:
    """``fileProfiles`` (name to extensions and filenames), ``defaultProfiles``, and what else the file holds; ``{"mode": "local"}`` without one."""
    try:
        with open(os.path.join(root, FILE), encoding="utf-8") as f:
            found = json.load(f)
    except FileNotFoundError:
        return {"mode": "local"}
    if not isinstance(found, dict):
        raise ValueError(f"{FILE} holds no object")
    return {"mode": "local"} | found
