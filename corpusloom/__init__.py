"""corpusloom: document retrieval, audit and corpus operators as Spark DataFrame plans."""
