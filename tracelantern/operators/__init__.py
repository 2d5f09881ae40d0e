"""Operators on ``lines(file_id, line_no, line)`` and on the tables derived from it."""
