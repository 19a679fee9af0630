"""pressmill: a Spark-first engine for news-article data."""
