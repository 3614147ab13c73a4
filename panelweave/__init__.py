"""panelweave: panel, pair and corpus analytics as Spark DataFrame operators."""

from panelweave.session import build_session, durable, tune

__all__ = ["build_session", "durable", "tune"]
