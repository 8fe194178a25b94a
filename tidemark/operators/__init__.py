"""Reusable DataFrame operators: as-of lookups, merges, calendars, bars."""
