"""Operators for text collections that feed language models; nothing outside this folder imports it."""
