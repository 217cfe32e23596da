"""The comparison with SQL that all tests share."""

from ..oracle import connection, same  # noqa: F401
