"""Named queries (one per operator of the inventory) and their oracle SQL."""
