"""quillgraph: document and code intelligence as PySpark DataFrame jobs."""
