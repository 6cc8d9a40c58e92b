"""Names that contracts fix."""

from __future__ import annotations

#: Column-name parts that a sealed identifier table must not have.
SEALED_PARTS = ("label", "status", "eligible")
