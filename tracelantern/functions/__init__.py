"""Column helpers: regex dialect, literal prefilters and text trimming."""
