"""Where sequences come from and results go."""
