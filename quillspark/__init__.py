"""quillspark: document and relational analytics expressed as Spark plans."""
