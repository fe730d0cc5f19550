"""Prompt-injection scanning and agent-session analytics on Spark DataFrames."""

from turnsift.config import ScanConfig

__all__ = ["ScanConfig"]
