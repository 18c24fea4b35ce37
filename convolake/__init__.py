"""Conversation-corpus analytics on Spark: every operator is a lazy DataFrame -> DataFrame function."""

__version__ = "0.1.0"
