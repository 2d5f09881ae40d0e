"""Fixed rows of the detection catalogue and their DataFrame forms."""
