"""Column builders: the rules of the game, text and season parsing, and the metric catalogue."""
