"""Where metadata, statements and results come from and go to."""
