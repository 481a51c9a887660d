"""Column functions: text, lists of lines, URLs, code, privacy. Nothing here runs a job."""
