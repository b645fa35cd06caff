"""Connected components, as the operators on documents and vectors import them."""

from folioscan.operators.components import connected_components

__all__ = ["connected_components"]
