"""Named queries."""

from __future__ import annotations

import importlib

MODULES = ("q_scan", "q_panel", "q_relational", "q_diff", "q_did", "q_gt", "q_fe", "q_pretrends", "q_power")


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"panelwright.plans.{m}")
