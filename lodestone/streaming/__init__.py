"""Stateful streams: the same operators over endless logs."""
