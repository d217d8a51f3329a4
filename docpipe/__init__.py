"""docpipe: collections of documents, queried by short pipelines of typed steps that compile to Spark."""
