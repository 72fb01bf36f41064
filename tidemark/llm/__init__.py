"""Training-data operators over text tables: token counts, deduplication, fingerprints,
secrets, personal data, decontamination, page extraction, quality and mixing.

Nothing else in the library imports this subpackage.
"""
