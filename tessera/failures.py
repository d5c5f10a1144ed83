"""Errors of pixels that name the raster and the operation they come from."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager


class RasterError(ValueError):
    """An operation on a raster's pixels failed."""


@contextmanager
def failing(origin: str, source: str | None = None) -> Iterator[None]:
    """Errors of what is done within, with the operation and, if known, the source."""
    try:
        yield
    except RasterError:
        raise
    except (ValueError, OSError) as e:
        where = f" on '{source}'" if source else ""
        raise RasterError(f"Raster operation '{origin}'{where} failed: {e}") from e
