"""Training-data operators over a table of documents. Nothing else in the library imports this subpackage."""
