"""Column builders: scalar functions and the document-filter compiler."""
