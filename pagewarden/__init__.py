"""Privacy and action audit over web-page tables, written as Spark DataFrame jobs."""

from pagewarden.session import build_session, configure

__all__ = ["build_session", "configure"]
