"""Vocabulary, intents and workspace settings: small values on the driver that shape the plans."""
