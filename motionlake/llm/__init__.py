"""Training-data preparation operators. Nothing else in the library imports this package."""
