"""Counts on streams of trips."""
