"""DataFrame-in, DataFrame-out operators: chunking, search, caches, statistics, prompts."""
