"""Plans: multi-step jobs made of operators, and what they share."""
