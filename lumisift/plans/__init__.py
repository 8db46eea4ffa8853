"""Named plans: the cull, and profiles."""
