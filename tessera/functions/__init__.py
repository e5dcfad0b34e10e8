"""Named derived columns and their registry."""
