"""Streaming is an extension: the batch operators hold without it."""
