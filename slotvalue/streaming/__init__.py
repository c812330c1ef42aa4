"""Structured Streaming jobs over the event log and incoming detections."""
