"""Reading and writing: glossaries, exchange with agents, saved states."""
