"""The data model and how questions become plans."""
