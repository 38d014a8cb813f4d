"""Readers of files into elements, tables and symbols, and sinks."""
