"""The full set of registered plans."""

from __future__ import annotations

from . import q_clean, q_flow, q_io, q_ml, q_profile, q_scale, q_stats  # noqa: F401  (registration side effects)
from .base import REGISTRY, full_sql


def queries():
    return {k: e.fn for k, e in REGISTRY.items()}


def oracle_sql():
    out = {}
    for k, e in REGISTRY.items():
        s = full_sql(e)
        if s is not None:
            out[k] = s
    return out
