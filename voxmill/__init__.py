"""Customer-feedback analytics as Spark DataFrame jobs."""

from voxmill.config import Config

__all__ = ["Config"]
