"""Operators that prepare training text: chat rendering, duplicates, token counts, shards, filters and mixing."""
