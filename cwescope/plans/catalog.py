"""All registered queries (importing the binding modules fills the registry)."""

from __future__ import annotations

from cwescope.plans import q_code, q_corpus, q_eval, q_graph, q_io, q_more, q_vectors  # noqa: F401
from cwescope.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
