"""The library's own code for the executors: see ``cairnlog.plans.shipping``."""

from __future__ import annotations

from cairnlog.plans.shipping import ship_code, tidied

__all__ = ["ship_code", "tidied"]
