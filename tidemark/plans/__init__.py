"""Registered queries: importing this package fills the registry."""

from tidemark.plans import documents, kept, lanes, listings, lists, matching, measures, pages, passes, published, registry, store, streams, texts  # noqa: F401
