"""Structured Streaming: event-time sequences and their re-segmentation."""
