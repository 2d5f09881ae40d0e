"""The line operators over log folders that keep growing."""
