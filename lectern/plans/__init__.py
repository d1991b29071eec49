"""Whole workflows: evaluation, quality control of a release, leaderboard."""
