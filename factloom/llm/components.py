"""Connected components of near copies: the library's own, by stars."""

from __future__ import annotations

from factloom.operators.components import components

__all__ = ["components"]
