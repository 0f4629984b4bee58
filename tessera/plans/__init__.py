"""The registered queries; importing this package registers them."""

from tessera.plans import ontology, rows, semantic, serving, sql_surface  # noqa: F401
