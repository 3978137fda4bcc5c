"""quirelake: Markdown-corpus analytics and search as PySpark DataFrame operators."""

__version__ = "0.1.0"
