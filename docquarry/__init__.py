"""docquarry: hybrid document retrieval, evidence analytics and data-set tooling as lazy Spark plans."""
