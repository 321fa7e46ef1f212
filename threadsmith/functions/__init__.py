"""Column-level scalars (URL, text, slug) and the per-row HTML helper."""

from . import text, urls  # noqa: F401
