"""Evidence capture and quality analytics as Spark jobs."""

from gleaner.config import EngineConfig
from gleaner.session import build_session

__all__ = ["EngineConfig", "build_session"]
