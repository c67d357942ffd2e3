"""tidemark: DataFrame operators for prediction-market analytics on Spark."""

from tidemark.config import DEFAULTS, merge_config
from tidemark.session import build_session

__all__ = ["DEFAULTS", "build_session", "merge_config"]
