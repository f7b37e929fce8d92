"""The demographic operators, one module per subject."""
