"""Plans over growing tables."""
