"""Operators on question, paper, change and file tables."""
