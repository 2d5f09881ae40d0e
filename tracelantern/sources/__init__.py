"""Where lines and rules come from."""
