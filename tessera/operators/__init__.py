"""DataFrame-to-DataFrame operators keyed by query or document."""
