"""Routing of questions and guarded SQL."""
