"""Operators over sequence, block and posterior tables."""
