"""A PySpark-native engine for static code indexes, with operators for training-data pipelines in lodeframe.llm."""
