"""Source-code corpora as Spark relations: files, tokens, symbols and nodes."""

from srcatlas.session import configure

__all__ = ["configure"]
