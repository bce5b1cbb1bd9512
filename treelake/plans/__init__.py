"""Plans and pass-through SQL."""
