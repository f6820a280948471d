"""quillmere: a document-knowledge analytics engine expressed as Spark plans."""

__version__ = "0.1.0"
