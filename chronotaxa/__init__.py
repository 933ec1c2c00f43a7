"""Versioned-checklist analytics and training-data preparation, expressed as Spark plans."""
