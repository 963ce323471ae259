"""Readers (``readers``) and writers (``sinks``)."""
