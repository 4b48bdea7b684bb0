"""Registered queries, one module per operator family; importing registers them."""

from inkwell.plans import (  # noqa: F401
    q_content, q_engagement, q_ingest, q_ops, q_recommend, q_registry, q_search, q_snaps, q_stories, q_stream, q_users)
from inkwell.plans.catalog import ORACLE, QUERIES  # noqa: F401
