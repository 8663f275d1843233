"""Scoring over streams of responses."""
