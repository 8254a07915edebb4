"""Catalogue of this package's queries."""

from __future__ import annotations

import importlib

_NAMES = ["q_runs", "q_tokens", "q_leaks", "q_lookalikes", "q_turns", "q_garble", "q_markup"]


def modules() -> list:
    return [importlib.import_module(f"subtide.llm.{name}") for name in _NAMES]
