"""paperloom: document-extraction analytics as DataFrame transformations."""
