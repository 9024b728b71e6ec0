"""Training-data operators: filtering, de-duplication, mixing, tokens, media."""
