"""Timetable, duty-roster and school-document analytics as DataFrame operators."""

__version__ = "0.1.0"
