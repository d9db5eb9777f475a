"""Mention-burst analytics and training-data operators as Spark jobs."""
