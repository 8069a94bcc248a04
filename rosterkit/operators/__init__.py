"""Roster operators: views, searches, dependency reports, writes, deletes, checks."""
