"""What the engine reads: build commands, package maps, source lines, and the engine's relations from benchmark tables."""
