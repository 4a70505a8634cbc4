"""Whole plans: a run, a replay of history, the employer universe."""
