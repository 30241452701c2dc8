"""Intermediate tables of these operators: those of the whole package."""

from ..storage import materialize, release, settle, share, shared_dir

__all__ = ["materialize", "release", "settle", "share", "shared_dir"]
