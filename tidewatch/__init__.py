"""Transaction monitoring as composable Spark DataFrame operators."""

from tidewatch.config import Config

__all__ = ["Config"]
