"""The registered queries. Importing this package registers all of them."""

from tidemark.queries import analytics, documents, evidence, history, reports, retrieval, states, trail  # noqa: F401
