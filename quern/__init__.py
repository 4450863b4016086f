"""quern: a Spark-first analytics engine for speech and text corpora."""
