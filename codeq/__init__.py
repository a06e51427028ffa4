"""codeq: code-quality analytics for corpora of source files, on Spark."""
