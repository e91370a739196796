"""Spark jobs for security logs and event document tables."""
