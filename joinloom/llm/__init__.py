"""Training-data operators: deduplication, tokenising, archives, quality, secrets, chat, language and mixing.

Nothing else in the library imports this subpackage.
"""
