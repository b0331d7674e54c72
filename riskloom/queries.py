"""All registered queries of the core library; importing the modules fills the registry."""

from __future__ import annotations

from . import queries_book, queries_components, queries_data, queries_descriptors, queries_membership, queries_moments, queries_more, queries_panel, queries_portfolio, queries_risk, queries_rolling, queries_running, queries_sources, queries_specific, queries_windows  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
