"""Registered queries: importing this package fills the registry."""

from tessera.plans import chat, graphs, hygiene, ingest, markdown, names, records, retrieval, streams, text, whole_texts  # noqa: F401
from tessera.plans.registry import QUERIES, SQL  # noqa: F401
